"""Off-policy value estimates and treatment effects, one row per experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = 1.96
FACTORS = (0.8, 0.9, 1.0, 1.1, 1.2)


def importance_ratio(clip_min: float = 0.0, clip_max: float = float("inf"), logging: Column | None = None) -> Column:
    """target / logging propensity, clipped; null when either is not positive."""
    p = F.col("logging_propensity") if logging is None else logging
    t = F.col("target_propensity")
    return F.when((p > 0.0) & (t > 0.0), F.greatest(F.lit(clip_min), F.least(F.lit(clip_max), t / p)))


def _estimate(values: DataFrame, keys: list[str], name: Column, value: str = "__x") -> DataFrame:
    """Mean, sample variance and interval of column ``__x``; fewer than two values give variance 0."""
    stats = values.groupBy(*keys).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.var_samp(value).alias("__v"))
    return _interval(stats.withColumn("__name", name), keys)


def _interval(stats: DataFrame, keys: list[str]) -> DataFrame:
    """name, value, n, variance, lower, upper from __name, __m, __n, __v."""
    few = F.col("__n") < 2
    mean = F.coalesce(F.col("__m"), F.lit(0.0))
    error = F.when(few, 0.0).otherwise(Z_95 * F.sqrt(F.col("__v") / F.col("__n")))
    return stats.select(
        *keys, F.col("__name").alias("name"), mean.alias("value"), F.col("__n").alias("n"), F.when(few, 0.0).otherwise(F.col("__v")).alias("variance"),
        (mean - error).alias("lower"), (mean + error).alias("upper"),
    )


def ips(events: DataFrame, keys: list[str], clip_min: float = 0.0, clip_max: float = float("inf")) -> DataFrame:
    weighted = events.withColumn("__x", importance_ratio(clip_min, clip_max) * F.col("reward"))
    return _estimate(weighted, keys, F.lit("ips"))


def snips(events: DataFrame, keys: list[str], clip_min: float = 0.0, clip_max: float = float("inf")) -> DataFrame:
    """Self-normalised; the variance of the weighted rewards is taken around this estimate, from centred moments."""
    w = events.withColumn("__w", importance_ratio(clip_min, clip_max)).withColumn("__x", F.col("__w") * F.col("reward"))
    stats = w.groupBy(*keys).agg(
        F.count("__x").alias("__n"), F.avg("__x").alias("__mean"), F.var_pop("__x").alias("__var"), F.sum("__x").alias("__sum"),
        F.sum(F.when(F.col("__x").isNotNull(), F.col("__w"))).alias("__mass"),
    )
    stats = stats.withColumn("__m", F.when(F.col("__mass") > 0.0, F.col("__sum") / F.col("__mass")).otherwise(0.0))
    # sum (x - m)^2 = n * (var_pop + (mean_x - m)^2)
    offset = F.col("__mean") - F.col("__m")
    variance = F.col("__n") * (F.col("__var") + offset * offset) / (F.col("__n") - 1)
    return _interval(stats.withColumn("__v", F.when(F.col("__n") > 1, variance)).withColumn("__name", F.lit("snips")), keys)


def doubly_robust(events: DataFrame, keys: list[str], clip_min: float = 0.0, clip_max: float = float("inf")) -> DataFrame:
    direct = F.coalesce(F.col("direct_estimate"), F.lit(0.0))
    value = direct + importance_ratio(clip_min, clip_max) * (F.col("reward") - direct)
    return _estimate(events.withColumn("__x", value), keys, F.lit("doubly_robust"))


def sensitivity(events: DataFrame, keys: list[str], factors: tuple[float, ...] = FACTORS, clip_min: float = 0.0, clip_max: float = float("inf")) -> DataFrame:
    """IPS with the logging propensity scaled by each factor: all factors in one scan, as columns, then unfolded."""
    columns = []
    for i, factor in enumerate(factors):
        x = importance_ratio(clip_min, clip_max, F.col("logging_propensity") * factor) * F.col("reward")
        columns.append(F.struct(F.lit(f"ips_perturbed_{factor:.2f}").alias("__name"), F.count(x).alias("__n"), F.avg(x).alias("__m"), F.var_samp(x).alias("__v")).alias(f"__f{i}"))
    wide = events.groupBy(*keys).agg(*columns)
    long = wide.select(*keys, F.inline(F.array(*[F.col(f"__f{i}") for i in range(len(factors))])))
    return _interval(long, keys)


def _clipped(propensity: str) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), F.col(propensity)))


def ate_weighted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Average treatment effect by inverse propensity. Columns treatment, outcome, propensity."""
    p = _clipped("propensity")
    x = F.when(F.col("treatment") == 1, F.col("outcome") / p).otherwise(-F.col("outcome") / (1.0 - p))
    return _estimate(rows.withColumn("__x", x), keys, F.lit("ate_ipw"))


def ate_doubly_robust(rows: DataFrame, keys: list[str], name: str = "ate_dr") -> DataFrame:
    """With outcome estimates y0 and y1."""
    p = _clipped("propensity")
    treated = F.col("y1") + (F.col("outcome") - F.col("y1")) / p - F.col("y0")
    control = F.col("y1") - (F.col("y0") + (F.col("outcome") - F.col("y0")) / (1.0 - p))
    return _estimate(rows.withColumn("__x", F.when(F.col("treatment") == 1, treated).otherwise(control)), keys, F.lit(name))


def off_policy_report(events: DataFrame, keys: list[str], clip_min: float = 0.0, clip_max: float = float("inf")) -> DataFrame:
    """ips, snips, doubly_robust and causal_ate. The last one counts every event."""
    estimate = F.coalesce(F.col("direct_estimate"), F.lit(0.0))
    causal = events.select(
        *keys,
        (F.col("target_propensity") > F.col("logging_propensity")).cast("int").alias("treatment"),
        F.col("reward").alias("outcome"),
        F.col("logging_propensity").alias("propensity"),
        estimate.alias("y0"),
        estimate.alias("y1"),
    )
    return (
        ips(events, keys, clip_min, clip_max)
        .unionByName(snips(events, keys, clip_min, clip_max))
        .unionByName(doubly_robust(events, keys, clip_min, clip_max))
        .unionByName(ate_doubly_robust(causal, keys, "causal_ate"))
    )


# Fixed output values: the three reasons of the guardrail.
TOO_SMALL = "ATE %.4f is below minimum threshold %.4f."
UNCERTAIN = "Lower confidence bound %.4f is below zero, effect not statistically significant."
PASSED = "Experiment passed causal guardrails."


def causal_guardrail(effects: DataFrame, min_effect: float = 0.01, min_lower: float = 0.0) -> DataFrame:
    """passed and reason per effect row: first the size, then the lower bound."""
    small, uncertain = F.col("value") < min_effect, F.col("lower") < min_lower
    reason = (
        F.when(small, F.format_string(TOO_SMALL, "value", F.lit(min_effect)))
        .when(uncertain, F.format_string(UNCERTAIN, "lower"))
        .otherwise(PASSED)
    )
    return effects.withColumn("passed", ~(small | uncertain)).withColumn("reason", reason)
