"""Readable reasons for ranked items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.operators.scale import top_n_per_group

# Names shown for signals; others are shown in title case.
SIGNAL_TITLES = {"rank_score": "Neural Alignment", "text": "Semantic Match", "multimodal": "Multimodal Fusion"}
NO_SIGNAL = "Neural Alignment"


def top_signals(signals: Sequence[str]) -> Column:
    """Display names of up to two positive signals, largest first, earlier listed first on ties."""
    entries = F.array(
        *[
            F.struct(
                (-F.coalesce(F.col(name), F.lit(0.0))).alias("neg"),
                F.lit(i).alias("i"),
                F.lit(SIGNAL_TITLES.get(name, name.replace("_", " ").title())).alias("name"),
            )
            for i, name in enumerate(signals)
        ]
    )
    positive = F.slice(F.array_sort(F.filter(entries, lambda e: e["neg"] < 0.0)), 1, 2)
    return F.when(F.size(positive) == 0, F.array(F.lit(NO_SIGNAL))).otherwise(F.transform(positive, lambda e: e["name"]))


def explain_items(ranked: DataFrame, signals: Sequence[str], k: int = 5) -> DataFrame:
    """Confidence, named signals and a sentence for the first ``k`` items of each query."""
    top = top_n_per_group(ranked, ["query_id"], [F.col("rank")], k, "__n").drop("__n")
    named = top.withColumn("primary_signals", F.array_join(top_signals(signals), " and "))
    sentence = F.format_string(
        "[Safety/Grounding Verified] %s is suggested for '%s' because it retained a strong ranking signal "
        "from %s. Final score %.3f.",
        "title",
        "query_title",
        "primary_signals",
        "score",
    )
    return named.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))).withColumn("rationale", sentence)


def explain_summary(queries: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One sentence per query, also for queries without any result."""
    means = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.avg("score").alias("mean_score"))
    found = F.format_string(
        "Recommendations for '%s' were selected using blended similarity signals, "
        "policy constraints, and diversity balancing. Mean confidence score is %.3f.",
        "query_title",
        "mean_score",
    )
    none = F.format_string(
        "No confident recommendations were found for '%s'. "
        "Try a nearby title, franchise entry, or a broader genre hint.",
        "query_title",
    )
    joined = queries.select("query_id", "query_title").join(means, "query_id", "left")
    return joined.withColumn("summary", F.when(F.col("mean_score").isNull(), none).otherwise(found))
