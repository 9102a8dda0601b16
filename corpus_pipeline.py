"""The corpus pipeline: from raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. The first four return the columns of ``docs``; the last one
returns where each piece of each document stands in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slatewise.llm.common import stored, table
from slatewise.llm.language import keep_known_languages
from slatewise.llm.near_copies import drop_near_copies
from slatewise.llm.packing import Capacity, pack, token_pieces
from slatewise.llm.quality import keep_good_documents
from slatewise.llm.queries import VOCABULARY
from slatewise.llm.secrets import redact_secrets

#: Classifiers and fingerprints are not SQL; tests hold the pipeline against a plain version of every stage.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognisable language go."""
    return keep_known_languages(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, puts into class 0 go."""
    return keep_good_documents(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    capacity = Capacity(tokens=2048)
    return pack(token_pieces(docs, public_tokenizers.path(VOCABULARY), capacity.tokens), capacity)


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", redact),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
