"""Catalogue lookup: title search, display names, id resolution, names mentioned in texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import expressions as X
from slatewise.operators.scale import bounded_broadcast, spread, spread_by


@F.pandas_udf(T.StringType())
def _fold_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii"))


def match_form(text: Column | str) -> Column:
    """ASCII without accents, lower case, without blanks and dots.

    Only texts that hold a non-ASCII character need the Python accent table, which gets the others as null.
    """
    value = F.col(text) if isinstance(text, str) else text
    foreign = value.rlike(r"[^\x00-\x7F]")
    folded = F.coalesce(_fold_accents(F.when(foreign, value)), value)
    return F.translate(F.lower(folded), " .", "")


GRAM = 3
STATISTICS_SHARE = 16


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters. One pass per offset, so the work is linear in the text."""
    runs = [F.regexp_extract_all(F.substr(text, F.lit(start + 1)), F.lit("(?s).{%d}" % size), F.lit(0)) for start in range(size)]
    return F.array_distinct(F.concat(*runs))


#: Letters of all names that one matcher takes; every Python worker holds one, of about 50 bytes a letter.
MATCHER_LETTERS = 2_000_000


def _shipped_names(names: DataFrame, letters: int) -> list[str] | None:
    """``needle`` of all rows in their order, or None when together they have more than ``letters`` letters."""
    size = names.agg(F.coalesce(F.sum(F.length("needle") + 1), F.lit(0))).first()[0]
    return [row[0] for row in names.select("needle").collect()] if size <= letters else None


def _scan(names: list[str], bodies: DataFrame, first_only: bool = False, fold: bool = False) -> DataFrame:
    """(needle, body_id) for every name, or only the first listed one, that occurs in a body: one pass over each body by a
    matcher with failure links over all names. A task holds one body at a time as text; with ``fold`` it is brought into
    ``match_form`` right there."""
    schema = T.StructType([T.StructField("needle", T.StringType()), T.StructField("body_id", bodies.schema["body_id"].dataType)])
    if not names:
        return bodies.sparkSession.createDataFrame([], schema)
    shipped = bodies.sparkSession.sparkContext.broadcast(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        listed, matcher = shipped.value, ahocorasick.Automaton()
        for number, name in enumerate(listed):
            matcher.add_word(name, number)
        matcher.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column(1)):
                body = value.as_py()
                if fold and body:
                    body = unicodedata.normalize("NFKD", body).encode("ascii", "ignore").decode("ascii").lower().translate({32: None, 46: None})
                hits = {number for _, number in matcher.iter(body)} if body else set()
                hits = [min(hits)] if first_only and hits else sorted(hits)
                found += [listed[number] for number in hits]
                rows += [row] * len(hits)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), ids], names=["needle", "body_id"])

    return bodies.select("body_id", "body").mapInArrow(scan, schema)


def contained_pairs(needles: DataFrame, bodies: DataFrame, letters: int = MATCHER_LETTERS) -> DataFrame:
    """(needle, body_id) for every needle that occurs literally in a body. ``needles``: needle; ``bodies``: body_id, body.
    Null and empty needles and null bodies give nothing.

    Needles of together at most ``letters`` letters, which is counted, travel to the bodies as one matcher. More are found by
    their rarest letter group, see ``_pairs_by_groups``.
    """
    needles = needles.select("needle").filter(F.col("needle") != "").distinct()
    names = _shipped_names(needles, letters)
    return _pairs_by_groups(needles, bodies) if names is None else _scan(names, bodies)


def _pairs_by_groups(needles: DataFrame, bodies: DataFrame) -> DataFrame:
    """``contained_pairs`` for any number of needles.

    A body can hold a needle only when it holds the needle's rarest letter group, so that group is the join key and only
    those candidates are checked. Ids travel through the join, texts do not. Needles shorter than a group use their
    rarest letter.
    """
    bodies = bodies.select("body_id", "body")
    candidates = None
    short = F.length("needle") < GRAM
    for size, part in ((GRAM, ~short), (1, short)):
        if size == 1 and not needles.filter(part).limit(1).count():
            continue
        # Any group of a needle gives the same pairs; how rare it is only decides the work, so a few bodies tell enough.
        some = bodies.filter(F.pmod(F.xxhash64("body_id"), F.lit(STATISTICS_SHARE)) == 0)
        frequency = some.select(F.explode(_grams(F.col("body"), size)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        held = bodies.select("body_id", F.explode(_grams(F.col("body"), size)).alias("g"))
        asked = needles.filter(part).select("needle", F.explode(_grams(F.col("needle"), size)).alias("g"))
        rarest = asked.join(frequency, "g", "left").groupBy("needle").agg(F.min_by("g", F.coalesce("n", F.lit(0))).alias("g"))
        found = held.join(bounded_broadcast(rarest), "g").select("needle", "body_id")
        candidates = found if candidates is None else candidates.unionByName(found)
    return candidates.join(bodies, "body_id").filter(F.contains("body", "needle")).select("needle", "body_id")


def search_titles(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (query_id, pos, title, exact): titles equal to the query, else titles containing it, ignoring case.

    ``queries``: query_id, query_text; ``catalog``: pos, title. Containment is literal and is decided once per distinct
    text and distinct title.
    """
    asked = queries.select("query_id", F.lower("query_text").alias("needle"))
    titles = spread_by(catalog.select(F.lower("title").alias("body")), "body").distinct()
    pairs = contained_pairs(asked, titles.select(F.col("body").alias("body_id"), "body")).withColumnRenamed("body_id", "hay")
    pairs = pairs.withColumn("exact", F.col("needle") == F.col("hay"))
    any_exact = pairs.groupBy("needle").agg(F.max("exact").alias("any_exact"))
    kept = pairs.join(any_exact, "needle").filter(F.col("exact") | ~F.col("any_exact"))
    return (
        asked.join(kept, "needle")
        .join(catalog.select("pos", "title", F.lower("title").alias("hay")), "hay")
        .select("query_id", "pos", "title", "exact")
    )


def distinct_names(catalog: DataFrame, column: str) -> DataFrame:
    """Distinct entries of a pipe-separated column."""
    return catalog.select(F.explode(X.split_pipe(column)).alias("name")).distinct()


def capitalized(title: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substr(title, F.lit(2))))


def titles_of_items(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``title``: by catalogue position when the id is a number in range, else by exact title."""
    by_pos = catalog.select(F.col("pos").cast("string").alias("item_id"), F.col("title").alias("by_pos"))
    by_title = catalog.select(F.col("title").alias("item_id")).distinct().withColumn("by_title", F.col("item_id"))
    number = F.when(F.col("item_id").rlike("^[0-9]+$"), F.regexp_replace("item_id", "^0+(?=[0-9])", "")).otherwise(F.col("item_id"))
    joined = ids.withColumn("__id", number).join(by_pos.withColumnRenamed("item_id", "__id"), "__id", "left").drop("__id")
    return joined.join(by_title, "item_id", "left").withColumn("title", F.coalesce("by_pos", "by_title")).drop("by_pos", "by_title")


def longest_mention(texts: DataFrame, names: DataFrame, fold: bool = True, letters: int = MATCHER_LETTERS) -> DataFrame:
    """Longest name contained in each text, after normalising both; earlier name on equal length.

    ``texts``: text_id, text; ``names``: pos, name. Returns text_id, name, pos. A matcher
    of counted size finds each text's best name in one pass; more names than it takes go by letter groups.
    """
    form = match_form if fold else (lambda c: F.lower(c))
    table = names.select("pos", "name", form(F.col("name")).alias("needle")).filter(F.col("needle") != "")
    # Of names that look the same only the longest, earliest one can win.
    table = table.groupBy("needle").agg(F.min(F.struct((-F.length("name")).alias("neg"), "pos", "name")).alias("n"))
    bodies = spread(texts.select("text_id", "text")).select(F.col("text_id").alias("body_id"), F.col("text").alias("body"))
    listed = _shipped_names(table.orderBy("n"), letters)
    formed = bodies.withColumn("body", F.lower("body"))
    if listed is None:
        pairs = contained_pairs(table, bodies.withColumn("body", match_form("body")) if fold else formed, letters)
    else:
        # Folded by the worker that matches, so that whole texts go to Python once.
        pairs = _scan(listed, bodies, True, fold=True) if fold else _scan(listed, formed, True)
    hits = pairs.join(table, "needle")
    return hits.groupBy("body_id").agg(F.min("n").alias("n")).select(F.col("body_id").alias("text_id"), F.col("n.name").alias("name"), F.col("n.pos").alias("pos"))
