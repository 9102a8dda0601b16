"""Score normalisation, blending and merging of candidate channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.scale import top_n_per_group

METHODS = ("minmax", "zscore", "sigmoid", "none")


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(1e-9)


def normalize_scores(candidates: DataFrame, method: str = "minmax", method_col: str | None = None) -> DataFrame:
    """Adds ``norm_score``, normalised over each (query_id, channel).

    The method is one name for all rows or a column. The group statistics are one aggregate joined back, so a channel
    holding most rows is combined on the map side and never gathered into a window.
    """
    if method_col is None and method not in METHODS:
        raise ValueError("unknown normalization")
    how = F.col(method_col) if method_col else F.lit(method)
    stats = candidates.groupBy("query_id", "channel").agg(
        F.min("score").alias("__lo"), F.max("score").alias("__hi"), F.avg("score").alias("__mean"), F.stddev_pop("score").alias("__std")
    )
    joined = candidates.join(stats, ["query_id", "channel"])
    minmax = F.when(_close(F.col("__lo"), F.col("__hi")), 0.0).otherwise((F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    zscore = F.when(F.col("__std") == 0.0, 0.0).otherwise((F.col("score") - F.col("__mean")) / F.col("__std"))
    value = (
        F.when(how == "minmax", minmax)
        .when(how == "zscore", zscore)
        .when(how == "sigmoid", X.sigmoid(F.col("score")))
        .when(how == "none", F.col("score"))
        .otherwise(F.raise_error(F.lit("unknown normalization")).cast("double"))
    )
    return joined.withColumn("norm_score", value).drop("__lo", "__hi", "__mean", "__std")


def blend_channels(candidates: DataFrame, weight_col: str = "weight") -> DataFrame:
    """Sum of weighted normalised scores per item with the share of each channel.

    Channels are few and fixed per query, so the maps stay small.
    """
    weighted = candidates.withColumn("__w", F.col("norm_score") * F.col(weight_col))
    per_channel = weighted.groupBy("query_id", "item_id", "channel").agg(
        F.sum("__w").alias("__w"), F.max_by("score", "pos").alias("__raw"), F.min("pos").alias("__pos"), F.count(F.lit(1)).alias("__times")
    )
    entry = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", value))))
    return per_channel.groupBy("query_id", "item_id").agg(
        F.sum("__w").alias("score"),
        F.when(F.sum("__times") == 1, F.min("channel")).otherwise("blend").alias("source"),
        F.min("__pos").alias("pos"),
        entry("__w").alias("sources"),
        entry("__raw").alias("raw_scores"),
    )


def blend_top_k(blended: DataFrame, k: int) -> DataFrame:
    return top_n_per_group(blended, ["query_id"], [F.col("score").desc(), F.col("pos"), F.col("item_id")], k)


def merge_best(candidates: DataFrame, order: str = "pos") -> DataFrame:
    """One row per (query_id, item_id): the highest score, the earliest on ties."""
    return top_n_per_group(candidates, ["query_id", "item_id"], [F.col("score").desc(), F.col(order)], 1, "__n").drop("__n")
