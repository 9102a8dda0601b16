"""Stored artist, book and film answers (JSON text) to facts, facts lines and candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise import schemas
from slatewise.functions import expressions as X

_NO_TEXT = "array<string>"


def _filled(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast(_NO_TEXT)), lambda v: v.isNotNull() & (v != ""))


def artist_facts(rows: DataFrame, payload: str = "payload", min_score: float = 50.0) -> DataFrame:
    """Tags with count >= 0 by count, top five; first three aliases; answers scored below 50 are dropped."""
    parsed = rows.withColumn("a", F.from_json(payload, schemas.ARTIST)).filter(F.coalesce(F.col("a.score"), F.lit(0.0)) >= min_score)
    tags = F.coalesce(F.col("a.tags"), F.array().cast("array<struct<name:string,count:long>>"))
    numbered = F.transform(tags, lambda t, i: F.struct((-F.coalesce(t["count"], F.lit(0))).alias("neg"), i.alias("i"), t["name"].alias("name")))
    ranked = F.array_sort(F.filter(numbered, lambda t: (t["neg"] <= 0) & t["name"].isNotNull() & (t["name"] != "")))
    out = parsed.select(
        *rows.columns,
        F.coalesce("a.name", F.lit("")).alias("name"),
        F.coalesce("a.type", F.lit("Unknown")).alias("entity_type"),
        F.coalesce("a.country", F.lit("Unknown")).alias("country"),
        F.transform(F.slice(ranked, 1, 5), lambda t: t["name"]).alias("genres"),
        F.coalesce(F.col("a.life-span.begin"), F.lit("")).alias("born"),
        F.coalesce("a.disambiguation", F.lit("")).alias("disambiguation"),
        F.slice(_filled(F.col("a.aliases.name")), 1, 3).alias("aliases"),
    )
    known = lambda c: F.when(F.col(c) != "Unknown", F.col(c))
    head = F.concat(F.lit("Truth File: Artist: "), F.col("name"))
    rest = X.facts_line(
        [("Type", known("entity_type")), ("Country", known("country")), ("Genres", F.array_join("genres", ", ")), ("Born", F.col("born")), ("About", F.col("disambiguation"))]
    )
    tail = F.replace(rest, F.lit("Truth File: "), F.lit(""))
    return out.withColumn("facts", F.when(tail == "", head).otherwise(F.concat(head, F.lit(" | "), tail)))


def book_facts(rows: DataFrame, payload: str = "payload", skip_prefixes: tuple[str, ...] = ("nyt:",)) -> DataFrame:
    """Subjects without the given prefixes, top eight; first three authors."""
    parsed = rows.withColumn("b", F.from_json(payload, schemas.BOOK))
    keep = _filled(F.col("b.subject"))
    if skip_prefixes:
        skipped = "^(" + "|".join(re.escape(p) for p in skip_prefixes) + ")"
        keep = F.filter(keep, lambda s: ~s.rlike(skipped))
    authors = F.coalesce(F.col("b.author_name"), F.array().cast(_NO_TEXT))
    out = parsed.select(
        *rows.columns,
        F.coalesce("b.title", F.lit("")).alias("title"),
        F.slice(authors, 1, 3).alias("authors"),
        F.col("b.first_publish_year").alias("first_publish_year"),
        F.slice(keep, 1, 8).alias("subjects"),
        F.col("b.cover_i").alias("cover_id"),
        F.coalesce("b.key", F.lit("")).alias("key"),
    )
    year = F.when(F.col("first_publish_year") != 0, F.col("first_publish_year").cast("string"))
    rest = X.facts_line([("Author", F.array_join("authors", ", ")), ("Published", year), ("Subjects", F.array_join(F.slice("subjects", 1, 5), ", "))])
    tail = F.replace(rest, F.lit("Truth File: "), F.lit(""))
    head = F.concat(F.lit("Truth File: Book: "), F.col("title"))
    return out.withColumn("facts", F.when(tail == "", head).otherwise(F.concat(head, F.lit(" | "), tail)))


def fact_candidates(ranked: DataFrame, domain: str, title: str, rank: str = "rank") -> DataFrame:
    """Rank-decayed score and its split into signals. Rank counts from 0."""
    step, text, popularity = (0.15, 0.7, 0.2) if domain == "music" else (0.1, 0.6, 0.3)
    scored = ranked.withColumn("score", X.rank_decayed_score(F.col(rank), step))
    return scored.select(
        *ranked.columns,
        X.stable_item_id(F.lit(domain), F.lower(F.col(title))).alias("item_id"),
        "score",
        (F.col("score") * text).alias("text"),
        F.lit(0.0).alias("multimodal"),
        (F.col("score") * popularity).alias("popularity"),
        F.lit(0.0).alias("recency"),
        (F.col("score") * 0.1).alias("novelty"),
    )


def film_facts(rows: DataFrame, catalog: DataFrame | None = None, payload: str = "payload", title: str = "title") -> DataFrame:
    """Director, first five cast names and the facts line; rows without an answer fall back to the catalogue."""
    parsed = rows.withColumn("f", F.from_json(payload, schemas.FILM_CREDITS))
    directors = F.filter(F.coalesce(F.col("f.crew"), F.array().cast("array<struct<name:string,job:string>>")), lambda c: c["job"] == "Director")
    names = F.coalesce(F.col("f.cast.name"), F.array().cast(_NO_TEXT))
    out = parsed.withColumn("director", F.coalesce(F.get(directors, F.lit(0))["name"], F.lit("Unknown"))).withColumn("cast", F.array_join(F.slice(names, 1, 5), ", "))
    line = F.concat(
        F.lit("Truth File: Movie: "), F.coalesce("f.title", F.col(title)), F.lit(" | Director: "), F.col("director"), F.lit(" | Cast: "), F.col("cast"),
        F.lit(" | Release: "), F.coalesce("f.release_date", F.lit("Unknown")), F.lit(" | Overview: "), F.coalesce("f.overview", F.lit("")),
    )
    if catalog is None:
        return out.withColumn("facts", F.when(F.col("f").isNotNull(), line)).drop("f")
    people = [F.when(F.col(f"actor_{i}_name") != "", F.col(f"actor_{i}_name")) for i in (1, 2, 3)]
    local = catalog.groupBy(F.lower("movie_title").alias("__t")).agg(
        F.min_by(F.struct(F.coalesce("director_name", F.lit("Unknown")).alias("director"), F.concat_ws(", ", *people).alias("cast")), "pos").alias("__c")
    )
    joined = out.withColumn("__t", F.lower(title)).join(local, "__t", "left")
    fallback = F.concat(F.lit("Truth File: Movie: "), F.initcap(title), F.lit(" | Director: "), F.col("__c.director"), F.lit(" | Cast: "), F.col("__c.cast"))
    answered = F.col("f").isNotNull()
    return (
        joined.withColumn("facts", F.when(answered, line).when(F.col("__c").isNotNull(), fallback))
        .withColumn("director", F.when(answered, F.col("director")).otherwise(F.coalesce("__c.director", F.lit("Unknown"))))
        .withColumn("cast", F.when(answered, F.col("cast")).otherwise(F.coalesce("__c.cast", F.lit(""))))
        .drop("f", "__c", "__t")
    )


def text_to_list(raw: Column | str) -> Column:
    """JSON list of strings; else the text cut at ``","`` without its outer brackets."""
    value = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.from_json(F.when(F.trim(value).startswith("["), value), "array<string>", {"mode": "PERMISSIVE"})
    stripped = F.regexp_replace(F.regexp_replace(value, r'^\["', ""), r'"\]$', "")
    return F.coalesce(parsed, F.split(stripped, '","'))


def zip_lists(rows: DataFrame, columns: list[str], out: str = "entries") -> DataFrame:
    """Parallel list texts to one array of structs, cut to the shortest list; one entry per first column, last one wins."""
    lists = rows
    for c in columns:
        lists = lists.withColumn(f"__{c}", text_to_list(c))
    shortest = F.least(*[F.size(f"__{c}") for c in columns])
    zipped = F.transform(
        F.when(shortest > 0, F.sequence(F.lit(0), shortest - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(*[F.get(F.col(f"__{c}"), i).alias(c) for c in columns]),
    )
    lists = lists.withColumn("__z", zipped)
    key = columns[0]
    final = F.filter("__z", lambda e, i: ~F.exists(F.slice("__z", i + 2, F.size("__z")), lambda later: later[key] == e[key]))
    return lists.withColumn(out, final).drop("__z", *[f"__{c}" for c in columns])
