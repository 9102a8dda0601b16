"""Append-only feature tables and vector tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.features import KEY_PARTS, feature_key
from slatewise.operators.vectors import usable_vectors


def append_features(records: DataFrame, path: str) -> None:
    """Records with key, checksum and write time; readers prune by feature and modality. ``seq`` decides which is newest."""
    rows = records.withColumn("key", feature_key()).withColumn("checksum", X.vector_checksum("vector")).withColumn("created_at", F.current_timestamp())
    rows.write.mode("append").partitionBy("feature_name", "modality").parquet(path)


def load_features(spark: SparkSession, path: str, feature_name: str | None = None, modality: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if feature_name is not None:
        table = table.filter(F.col("feature_name") == feature_name)
    if modality is not None:
        table = table.filter(F.col("modality") == modality)
    return table.select("key", *KEY_PARTS, "vector", "checksum", "created_at", "seq")


def build_vector_table(items: DataFrame, path: str, partitions: int | None = None) -> None:
    """(pos, item_id, vector, domain), clustered by domain so that a domain filter skips files."""
    table = usable_vectors(items).select("pos", "item_id", F.col("vector").cast("array<float>").alias("vector"), "domain")
    table = table.repartitionByRange(partitions, "domain", "pos") if partitions else table.repartitionByRange("domain", "pos")
    table.write.mode("overwrite").parquet(path)


def load_vector_table(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    if table.limit(1).count() == 0:
        raise ValueError("vector table is empty")
    return table.withColumn("vector", F.col("vector").cast("array<double>"))
