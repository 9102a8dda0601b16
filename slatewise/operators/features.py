"""Feature vectors: hash encoding, fusing modalities, and the append-only feature table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.session import reliable_checkpoint

KEY_PARTS = ("namespace", "entity_type", "entity_id", "feature_name", "feature_version", "modality")


def feature_key() -> Column:
    return F.concat_ws(":", *[F.col(p) for p in KEY_PARTS])


def encoder_input(modality: str, title: str = "title", overview: str = "overview", uris: str = "uris") -> Column:
    """Text: title and overview. Other modalities: the asset uris, or the title when there are none."""
    if modality == "text":
        return F.when(F.col(overview).isNull(), F.col(title)).otherwise(F.concat_ws(" ", title, overview))
    return F.when(F.size(F.coalesce(F.col(uris), F.array().cast("array<string>"))) > 0, F.array_join(uris, " ")).otherwise(F.col(title))


def encode_by_hash(items: DataFrame, text: Column, dim: int = 32, token_limit: int = 12) -> DataFrame:
    """Adds vector and attributes for a text expression; deterministic, no model."""
    return items.withColumn("vector", X.hash_vector(text, dim)).withColumn("attributes", X.first_tokens(text, token_limit))


def fuse_modalities(vectors: DataFrame) -> DataFrame:
    """Element-wise mean per item; an empty vector when lengths differ. ``vectors``: item_id, modality, vector.

    The mean is taken per (item, place), so partial sums meet on the map side.
    """
    sizes = vectors.groupBy("item_id").agg((F.min(F.size("vector")) == F.max(F.size("vector"))).alias("same"))
    cells = vectors.select("item_id", F.posexplode("vector").alias("i", "v")).groupBy("item_id", "i").agg(F.avg("v").alias("m"))
    packed = cells.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))
    joined = sizes.join(packed, "item_id", "left")
    return joined.select("item_id", F.when(F.col("same"), F.col("mean")).otherwise(F.array().cast("array<double>")).alias("vector"))


def latest_features(table: DataFrame) -> DataFrame:
    """Newest record of each key by ``seq``. One partial aggregate: a key written many times never meets in one task."""
    rest = [c for c in table.columns if c != "key"]
    newest = table.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return newest.select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup_features(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest record per requested key; keys without one keep nulls."""
    keys = wanted.select("key").distinct()
    narrowed = table.join(keys, "key", "left_semi")
    return wanted.join(latest_features(narrowed), "key", "left")


def missing_keys(table: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(table.select("key").distinct(), "key", "left_anti")


def get_or_compute(table: DataFrame, wanted: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Vectors of all wanted keys: stored ones, plus ``encode`` on the absent ones, appended under ``path`` when given."""
    stored = wanted.join(latest_features(table).select("key", "vector"), "key").select("key", "vector")
    fresh = encode(missing_keys(table, wanted))
    if path is not None:
        # Fixed before the append, so that a retried task does not see its own output as stored.
        fresh, stored = reliable_checkpoint(fresh), reliable_checkpoint(stored)
        fresh.write.mode("append").parquet(path)
    return stored.unionByName(fresh.select("key", "vector"))


def distinct_key_count(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("keys"))
