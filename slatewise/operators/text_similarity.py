"""Bag-of-words counts and cosine similarity of a query batch against a text table."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import expressions as X
from slatewise.operators.blocked_topk import BROADCAST_BYTES, Best, blocked_top_k, drop_own_group, own_groups
from slatewise.operators.scale import by_shuffle, spread, spread_by, top_n_per_group
from slatewise.session import written

#: Distinct queries that travel to the texts as one batch, if their counted size allows it too.
BATCH_QUERIES = 32_768
#: More queries are dealt into blocks of about so many, and of words of about so many bytes: each is indexed by one task.
BLOCK_QUERIES, BLOCK_BYTES = 8192, 4 * 1024 * 1024
#: Texts and letters of a part that a block of queries meets, at most about, and texts of it that are cut into words at once.
PART_ROWS, PART_LETTERS, TEXTS_AT_ONCE = 65536, 16 * 1024 * 1024, 1024


def bag_of_words(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_short: bool = False) -> DataFrame:
    """(key, token, tf). Words of two or more characters; ``keep_short`` splits on blanks and keeps every piece."""
    docs = spread(docs)
    words = X.blank_tokens(text) if keep_short else X.word_list(text)
    return docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def _asked_once(rows: DataFrame, words: Column, extras: list[str]) -> DataFrame:
    """(query_id, bag, words, extras): one row for all queries with the same words (in any order) and extras. They are hashed, not
    sorted, so a task holds the distinct ones."""
    lines = rows.select("query_id", F.array_join(F.sort_array(words), " ").alias("line"), *extras)
    named = lines.groupBy("line", *extras).agg(F.min("query_id").alias("query_id"))
    listed = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))
    return named.select("query_id", F.sha2("line", 256).alias("bag"), listed.alias("words"), *extras)


def _prepare(batch: pd.DataFrame):
    """Inverted index of the batch: per word the queries holding it and how often. As large as the batch itself."""
    counts = [Counter(w) for w in batch["words"]]
    holders: dict[str, list[tuple[int, int]]] = {}
    for row, words in enumerate(counts):
        for word, n in words.items():
            holders.setdefault(word, []).append((row, n))
    index = {w: (np.array([r for r, _ in h], dtype=np.int64), np.array([n for _, n in h], dtype=np.float64)) for w, h in holders.items()}
    length = np.array([np.sqrt(float(sum(n * n for n in c.values()))) for c in counts])
    return index, np.where(length == 0.0, 1.0, length), own_groups(batch)


def _cosine(prepared, items: pd.DataFrame) -> np.ndarray:
    index, length, own = prepared
    scores = np.zeros((len(length), len(items)))
    for column, words in enumerate(items["words"]):
        counts = Counter(words)
        known = [(index[w], n) for w, n in counts.items() if w in index]
        if not known:
            continue
        norm = np.sqrt(float(sum(n * n for n in counts.values())))
        rows = np.concatenate([r for (r, _), _ in known])
        products = np.concatenate([tf * n for (_, tf), n in known])
        scores[:, column] = np.bincount(rows, products, minlength=len(length)) / (length * norm)
    drop_own_group(scores, own, items)
    return scores


def _dealt_top_k(items: DataFrame, words: Column, named: DataFrame, size: int, depth: int, part_rows: int) -> DataFrame:
    """Best positions of any number of queries: blocks of queries meet parts of the texts, each pair of them in a group of bounded
    size. A text travels once to every block, a query once to every part, and no pair of a text and a query travels
    before it is among the best ``depth`` of its part.
    """
    groups, own = (["item_group"], ["own_group"]) if "own_group" in named.columns else ([], [])
    texts, letters = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-texts // part_rows), -(-letters // PART_LETTERS))
    blocks = max(1, -(-named.count() // BLOCK_QUERIES), -(-size // BLOCK_BYTES))
    dealt = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    line = F.array_join(words, " ")
    asked = named.select("query_id", F.array_join("words", " ").alias("line"), *own, dealt("query_id", blocks).alias("block"))
    left = spread_by(asked.withColumn("part", every(parts)), "block", "part")
    right = items.select(F.col("pos").cast("long").alias("pos"), line.alias("line"), *groups)
    right = spread_by(right.withColumn("part", dealt("pos", parts)).withColumn("block", every(blocks)), "block", "part")

    def listed(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(words=[row.split(" ") if row else [] for row in frame["line"]]).drop(columns="line")

    def meet(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        best = Best(depth)
        if len(queries) and len(part):
            prepared = _prepare(listed(queries))
            for start in range(0, len(part), TEXTS_AT_ONCE):
                best.add_all(_cosine, prepared, len(queries), listed(part.iloc[start : start + TEXTS_AT_ONCE]))
        return best.frame(queries["query_id"].to_numpy())

    found = T.StructType([T.StructField("query_id", named.schema["query_id"].dataType), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])
    keys = ["block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, found)
    return top_n_per_group(met, ["query_id"], [F.col("score").desc(), F.col("pos")], depth)


def text_top_k(
    items: DataFrame, queries: DataFrame, k: int, words: Column | None = None, exclude_self: bool = False,
    broadcast_queries: int = BATCH_QUERIES, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Best ``k`` texts per query by cosine of word counts. ``items``: pos, text (item_group); ``queries``: query_id, text
    (self_pos, own_group). Texts without a common word score 0 and come last, by position.

    Equal queries are searched once. A batch of them whose counted size fits travels to the texts, which are scanned once and not
    moved; more queries meet the texts in blocks.
    """
    words = X.word_list("text") if words is None else words
    depth = k + exclude_self
    by_group = "own_group" in queries.columns
    groups, own = (["item_group"], ["own_group"]) if by_group else ([], [])
    named = written(_asked_once(queries, words, own), "asked")
    rows, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    if rows <= broadcast_queries and size <= BROADCAST_BYTES:
        placed = spread(items).select(F.col("pos").cast("long").alias("pos"), "text", *groups)
        complete = blocked_top_k(placed.select("pos", words.alias("words"), *groups), named.select("query_id", "words", *own), depth, _prepare, _cosine)
    else:
        complete = _dealt_top_k(items, words, named, size, depth, part_rows)

    # The ``depth`` answers of a query are one row, already in order; a query that leaves itself out drops it from the list.
    packed = complete.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "pos", "score"))).alias("best"))
    told = named.select("query_id", "bag", *own).join(by_shuffle(packed), "query_id").select(F.col("bag").alias("__bag"), *[F.col(c).alias(f"__{c}") for c in own], "best")
    asking = queries.select("query_id", F.sha2(F.array_join(F.sort_array(words), " "), 256).alias("bag"), *own, *(["self_pos"] if exclude_self else []))
    same = F.col("bag").eqNullSafe(F.col("__bag"))
    for column in own:
        same = same & F.col(column).eqNullSafe(F.col(f"__{column}"))
    answers = asking.join(by_shuffle(told), same)
    best = F.filter("best", lambda x: ~x["pos"].eqNullSafe(F.col("self_pos"))) if exclude_self else F.col("best")
    answers = answers.select("query_id", F.posexplode(F.slice(best, 1, k)).alias("place", "found"))
    return answers.select("query_id", "found.pos", "found.score", (F.col("place") + 1).cast("long").alias("rank"))


def text_candidates(
    items: DataFrame, queries: DataFrame, k: int = 200, attribute_count: str | None = "attribute_count", bonus: float = 0.02
) -> DataFrame:
    """Text channel: top ``k`` without the query item, score raised by 0.02 per attribute of the candidate.

    With ``own_group`` among the query's columns, items whose ``item_group`` is the same are left out before the cut.
    """
    found = text_top_k(items, queries, k, exclude_self="self_pos" in queries.columns)
    keep = ["pos", "item_id", "title", *([attribute_count] if attribute_count else [])]
    joined = found.withColumnRenamed("score", "text").join(by_shuffle(items.select(*keep)), "pos")
    lift = F.col(attribute_count) * bonus if attribute_count else F.lit(0.0)
    return joined.withColumn("multimodal", lift).withColumn("score", F.col("text") + F.col("multimodal"))


def similar_titles(items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar texts of every text in the table, itself removed by position."""
    queries = items.select(F.col("pos").alias("query_id"), "text", F.col("pos").alias("self_pos"))
    return text_top_k(items, queries, k, exclude_self=True)
