"""Exposure, long-tail and provider audits of recommendation lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators.scale import HOT_GROUP_ROWS, running_sums


@dataclass(frozen=True)
class FairnessLimits:
    max_exposure_gap: float = 0.10
    min_long_tail_coverage: float = 0.05
    long_tail_percentile: float = 0.20


def _named(column: str):
    return F.coalesce(F.when(F.col(column).cast("string") != "", F.col(column).cast("string")), F.lit("unknown"))


def cohort_exposure(recommended: DataFrame, catalog_counts: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Share of the slots against share of the catalogue per cohort. ``catalog_counts``: cohort, n."""
    got = recommended.groupBy(_named(cohort).alias("cohort")).agg(F.count(F.lit(1)).alias("item_count"))
    want = catalog_counts.select("cohort", "n")
    slots = recommended.agg(F.count(F.lit(1)).alias("__slots"))
    whole = catalog_counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).alias("__whole"))
    both = got.join(want, "cohort", "full_outer").join(F.broadcast(slots)).join(F.broadcast(whole))
    both = both.filter(F.col("__slots") > 0).fillna(0, ["item_count", "n"])
    return both.select(
        "cohort", "item_count",
        (F.col("item_count") / F.col("__slots")).alias("exposure_share"),
        (F.col("n") / F.col("__whole")).alias("ideal_share"),
        (F.col("item_count") / F.col("__slots") - F.col("n") / F.col("__whole")).alias("gap"),
    )


def long_tail_coverage(
    recommended: DataFrame, popularity: DataFrame, percentile: float = 0.20, hot_rows: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """One row. The tail is every item whose popularity is at most the value at rank ``int(n * percentile)``.

    Equal values are counted together first. ``recommended``: item_id; ``popularity``: item_id, popularity.
    """
    values = popularity.groupBy("popularity").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(values, [], ["popularity"], {"upto": "n"}, hot_rows)
    size = popularity.agg(F.count(F.lit(1)).alias("total"))
    place = F.least(F.floor(F.col("total") * percentile), F.col("total") - 1)
    limit = ranked.join(F.broadcast(size)).filter(F.col("upto") > place).agg(F.min("popularity").alias("limit"))
    tail = popularity.join(F.broadcast(limit)).filter(F.col("popularity") <= F.col("limit")).select("item_id")
    tail_size = tail.agg(F.count(F.lit(1)).alias("tail_items"))
    seen = recommended.select("item_id").distinct().join(tail, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("recommended_tail_items"))
    slots = recommended.agg(F.count(F.lit(1)).alias("slots"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return tail_size.join(seen).join(slots).select(
        "tail_items", "recommended_tail_items",
        ratio("recommended_tail_items", "slots").alias("long_tail_ratio"),
        ratio("recommended_tail_items", "tail_items").alias("coverage"),
    )


def provider_concentration(recommended: DataFrame, provider: str = "provider", hot_rows: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """Providers, Gini of their slot counts, share of the largest.

    Providers with the same count are folded: a run of ``c`` equal counts occupies ranks a+1 .. a+c, whose sum is closed.
    """
    counts = recommended.groupBy(_named(provider).alias("provider")).agg(F.count(F.lit(1)).alias("v"))
    runs = counts.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sums(runs, [], ["v"], {"upto": "c"}, hot_rows)
    whole = runs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("v")), F.lit(0)).alias("total"), F.max("v").alias("top"))
    before = (F.col("upto") - F.col("c")).cast("double")
    rank_sum = F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2.0
    spread = ranked.join(F.broadcast(whole)).agg(F.sum((2.0 * rank_sum - F.col("c") * (F.col("n") + 1)) * F.col("v")).alias("spread"))
    return whole.join(spread).select(
        F.col("n").alias("providers"),
        F.when((F.col("n") > 1) & (F.col("total") > 0), F.col("spread") / (F.col("n") * F.col("total"))).otherwise(0.0).alias("gini"),
        F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0).alias("top_share"),
    )


def fairness_report(recommended: DataFrame, catalog_counts: DataFrame, popularity: DataFrame, limits: FairnessLimits = FairnessLimits()) -> DataFrame:
    """One row with gap, coverage, concentration and the two pass flags. ``recommended``: item_id, cohort, provider."""
    gap = cohort_exposure(recommended, catalog_counts).agg(F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("exposure_gap"))
    tail = long_tail_coverage(recommended, popularity, limits.long_tail_percentile)
    row = gap.join(tail).join(provider_concentration(recommended))
    return row.withColumn("passes_exposure", F.col("exposure_gap") <= limits.max_exposure_gap).withColumn(
        "passes_coverage", F.col("coverage") >= limits.min_long_tail_coverage
    )
