"""Small awkward tables and plain versions of what the operators compute."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns carry names that operators use inside.
DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, fp string, found string"


def documents(spark: SparkSession, texts: list, ids: list | None = None, langs: list | None = None) -> DataFrame:
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, la, "s", None if t is None else len(t), 1, "x", "y") for i, t, la in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCUMENT_SCHEMA).repartition(3)


def words_text(rng: random.Random, words: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(words))


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
