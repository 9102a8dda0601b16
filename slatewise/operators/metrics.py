"""Offline ranking metrics, impression summaries and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatewise.functions import expressions as X


def ranking_metrics(recommended: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """NDCG@k, recall@k, MRR@k and MAP@k per query; 0 for queries without recommendations or relevant items.

    ``recommended``: query_id, position (from 0), item_id; ``relevant``: query_id, item_id; ``queries``: query_id.
    A list is cut to its first ``k`` places before it is joined; an item listed twice counts at its first place.
    """
    truth = relevant.select("query_id", "item_id").distinct()
    listed = recommended.filter(F.col("position") < k)
    first = listed.groupBy("query_id", "item_id").agg(F.min("position").alias("position"))
    hits = first.join(truth, ["query_id", "item_id"], "left_semi")
    # At most k rows per query from here on.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    per_query = (
        hits.withColumn("nth", nth)
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.sum(X.discount(F.col("position"))).alias("dcg"),
            F.min("position").alias("best"),
            F.sum(F.col("nth") / (F.col("position") + 1)).alias("precision_sum"),
        )
    )
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    joined = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(per_query, "query_id", "left")
    depth = F.least(F.col("relevant"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(0).cast("long"), depth - 1), F.lit(0.0), lambda acc, i: acc + X.discount(i))
    value = lambda c: F.when(F.col("hits") > 0, c).otherwise(0.0)
    return joined.select(
        "query_id",
        value(F.col("dcg") / ideal).alias("ndcg"),
        value(F.col("hits") / F.col("relevant")).alias("recall"),
        value(1.0 / (F.col("best") + 1)).alias("mrr"),
        value(F.col("precision_sum") / depth).alias("map"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    zero = lambda name: F.coalesce(F.avg(name), F.lit(0.0)).alias(name)
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[zero(m) for m in ("ndcg", "recall", "mrr", "map")])


def default_rewards(slots: DataFrame, rewards: DataFrame) -> DataFrame:
    """Reward per impression: the given one, else the number of shown items that were clicked."""
    clicks = slots.groupBy("impression_id").agg(F.sum(F.col("clicked").cast("int")).cast("double").alias("clicked"))
    return clicks.join(rewards, "impression_id", "left").select("impression_id", F.coalesce("reward", "clicked").alias("reward"))


def impression_summary(slots: DataFrame, clicks: DataFrame, rewards: DataFrame, k: int = 10) -> DataFrame:
    """One row: impressions, clicks, CTR, mean reward, coverage, metrics at k, distinct items.

    ``slots``: impression_id, position, item_id, clicked; ``clicks``: impression_id, item_id (also items not shown);
    ``rewards``: impression_id, reward (nullable).
    """
    shown = slots.agg(F.count(F.lit(1)).alias("shown"))
    unique = slots.groupBy("item_id").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("unique_items"))
    clicked = clicks.select("impression_id", "item_id").distinct().agg(F.count(F.lit(1)).alias("clicks"))
    reward = default_rewards(slots, rewards).agg(F.avg("reward").alias("mean_reward"))
    named = lambda df: df.withColumnRenamed("impression_id", "query_id")
    metrics = mean_metrics(ranking_metrics(named(slots), named(clicks), named(slots), k)).withColumnRenamed("queries", "impressions")
    # Five one-row tables side by side.
    row = shown.join(unique).join(clicked).join(reward).join(metrics)
    ratio = lambda c: F.when(F.col("shown") > 0, F.col(c) / F.col("shown")).otherwise(0.0)
    return row.select("impressions", "shown", "clicks", ratio("clicks").alias("ctr"), "mean_reward", ratio("unique_items").alias("coverage"), "ndcg", "mrr", "map", "recall", "unique_items")


def calibration(scored: DataFrame, prediction: str = "prediction", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (prediction clipped for binning) and Brier score (raw prediction)."""
    p = F.col(prediction)
    clipped = X.clip(p, 0.0, 1.0)
    bucket = F.least((clipped * bins).cast("int"), F.lit(bins - 1))
    table = scored.select(bucket.alias("bin"), clipped.alias("c"), F.col(label).alias("y"), ((p - F.col(label)) * (p - F.col(label))).alias("b"))
    per_bin = table.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"), F.sum("b").alias("b"))
    total = F.sum("n")
    return per_bin.agg(
        F.coalesce(total, F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / total, F.lit(0.0)).alias("ece"),
        F.coalesce(F.sum("b") / total, F.lit(0.0)).alias("brier"),
    )
