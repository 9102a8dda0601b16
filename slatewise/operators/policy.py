"""Exposure and diversity re-ranking of slates, and the shadow score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.scale import HOT_GROUP_ROWS, numbered, settle


def cohort_exposure_penalty(
    slates: DataFrame, max_per_cohort: int = 3, step: float = 0.1, cohort: str = "cohort", rank: str = "rank",
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """From the fourth item of a cohort on, subtract 0.1, 0.2, ... and order the slate again.

    Adds ``penalized_score`` and ``new_rank``. Rows without a cohort are never penalised.
    """
    hot_rows = settle(slates, ["query_id"], hot_rows)
    counted = numbered(slates, ["query_id", cohort], [rank], "__seen", hot_rows)
    excess = F.col("__seen") - max_per_cohort
    penalty = F.when(F.col(cohort).isNotNull() & (excess > 0), excess * step).otherwise(0.0)
    scored = counted.withColumn("penalized_score", F.col("score") - penalty).withColumn("__neg", -F.col("penalized_score"))
    return numbered(scored, ["query_id"], ["__neg", rank], "new_rank", hot_rows).drop("__seen", "__neg")


def diversity_rerank(
    slates: DataFrame, max_per_group: int = 2, relevance_weight: float = 0.75, diversity_weight: float = 0.25,
    group: str = "group_key", rank: str = "rank", hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Greedy diversity order as window functions.

    The n-th item taken from a group (n from 0) is always its n-th best, with key ``relevance * score - diversity * n``
    that never grows along the group, so picking greedily is one sort by that key. Items past the cap follow in their
    old order.
    """
    if relevance_weight <= 0.0 or diversity_weight < 0.0:
        raise ValueError("relevance weight must be positive and diversity weight not negative")
    hot_rows = settle(slates, ["query_id"], hot_rows)
    negated = slates.withColumn("__neg", -F.col("score"))
    counted = numbered(negated, ["query_id", group], ["__neg", rank], "__nth", hot_rows).withColumn("__nth", F.col("__nth") - 1)
    capped = (F.col("__nth") >= max_per_group).cast("int")
    key = F.when(capped == 1, 0.0).otherwise(diversity_weight * F.col("__nth") - relevance_weight * F.col("score"))
    keyed = counted.withColumn("__phase", capped).withColumn("__key", key)
    return numbered(keyed, ["query_id"], ["__phase", "__key", rank], "new_rank", hot_rows).drop("__neg", "__nth", "__phase", "__key")


def shadow_score(slates: DataFrame, query_text: str = "query_text", title: str = "title", bonus: float = 0.05) -> DataFrame:
    """Score plus 0.05 for each word shared by query and title, at most 1, beside the real score."""
    query_words = F.array_distinct(X.blank_tokens(F.coalesce(F.col(query_text), F.lit(""))))
    shared = F.size(F.array_intersect(query_words, F.array_distinct(X.blank_tokens(title))))
    return slates.withColumn("word_overlap", shared).withColumn(
        "shadow_score", F.least(F.lit(1.0), F.col("score") + F.col("word_overlap") * bonus)
    )
