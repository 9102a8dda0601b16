"""The registered queries of the operators, op<number>_<name>, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import sql
from slatewise.llm.bpe import bpe_round_trip
from slatewise.llm.common import table
from slatewise.llm.language import identify_languages
from slatewise.llm.licenses import scan_licenses
from slatewise.llm.neighbours import index, search
from slatewise.llm.packing import Capacity, pack, token_pieces
from slatewise.llm.quality import score_quality
from slatewise.llm.ranked_bpe import ranked_round_trip
from slatewise.llm.rules import judge
from slatewise.llm.runs import periodic_runs, planted, runs_digest
from slatewise.llm.secrets import secret_digest
from slatewise.llm.simhash import fingerprint_hex, near_duplicates
from slatewise.llm.vector_codes import compressed
from slatewise.llm.warc import archive_round_trip
from slatewise.queries.registry import Registered

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    capacity = Capacity(tokens=2048)
    pieces = token_pieces(table(spark, folder, "documents"), vocabulary(), capacity.tokens)
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_round_trip(table(spark, folder, "documents"), vocabulary())


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(index(table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents")).drop("char_distance", "word_distance")


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(table(spark, folder, "pages"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_digest(periodic_runs(planted(table(spark, folder, "documents"))))


def op12_ranked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_round_trip(table(spark, folder, "documents"), public_tokenizers.path(RANKS))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(table(spark, folder, "embeddings"))


def llm_queries() -> dict[str, Registered]:
    return {
        "op1_secret_scan": Registered(op1_secret_scan, sql.secrets_sql()),
        "op2_best_fit_packing": Registered(op2_best_fit_packing, None),
        "op3_license_scan": Registered(op3_license_scan, sql.licenses_sql()),
        "op4_language_id": Registered(op4_language_id, None),
        "op5_quality_classifier": Registered(op5_quality_classifier, None),
        "op6_bpe_round_trip": Registered(op6_bpe_round_trip, None),
        "op7_nearest_neighbours": Registered(op7_nearest_neighbours, sql.NEIGHBOURS),
        "op8_quality_rules": Registered(op8_quality_rules, sql.rules_sql()),
        "op9_simhash_near_dedup": Registered(op9_simhash_near_dedup, None),
        "op10_warc_bundles": Registered(op10_warc_bundles, sql.WARC),
        "op11_periodic_runs": Registered(op11_periodic_runs, None),
        "op12_ranked_bpe": Registered(op12_ranked_bpe, None),
        "op13_vector_codes": Registered(op13_vector_codes, sql.vector_codes_sql()),
    }
