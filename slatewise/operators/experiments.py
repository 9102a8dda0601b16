"""Hash assignment of users to variants, the two-sample test and the release gate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import expressions as X


def _pick(point: Column, variants: Sequence[tuple[str, float]], rest: str) -> Column:
    chosen, upper, steps = F.lit(rest), 0.0, []
    for name, share in variants:
        upper += share
        steps.append((name, upper))
    for name, limit in reversed(steps):
        chosen = F.when(point <= F.lit(limit), F.lit(name)).otherwise(chosen)
    return chosen


def assign_variant(user: Column | str, variants: Sequence[tuple[str, float]]) -> Column:
    """MD5 of the user modulo 10000 against cumulative shares; the last variant takes the rest."""
    rest = variants[-1][0] if variants else "control"
    return _pick(X.md5_bucket(user) / 10000.0, variants, rest)


def assign_group(user: Column, experiment: str, experiments: dict[str, Sequence[tuple[str, float]]], salt: str) -> Column:
    """Salted assignment; control without a user, for an unknown experiment, and for the rest of the shares."""
    if experiment not in experiments:
        return F.lit("control")
    point = X.hex_fraction(F.md5(F.concat(user, F.lit(f"_{experiment}_{salt}"))))
    known = F.coalesce(user != "", F.lit(False))
    return F.when(known, _pick(point, experiments[experiment], "control")).otherwise("control")


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of a z value; applied to one row per experiment."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))


def experiment_test(rows: DataFrame, keys: list[str], alpha: float = 0.05, mde: float = 0.05, min_rows: int = 30) -> DataFrame:
    """Lift, unpooled z, p value and gate from (keys, variant in control/treatment, metric)."""
    side = lambda name: F.when(F.col("variant") == name, F.col("metric"))
    a, b = side("control"), side("treatment")
    stats = rows.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.avg(a).alias("mean_a"), F.var_samp(a).alias("var_a"),
        F.count(b).alias("n_b"), F.avg(b).alias("mean_b"), F.var_samp(b).alias("var_b"),
    )
    enough = (F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows)
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    lift = F.when(enough & (F.col("mean_a") > 0), (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a")).otherwise(0.0)
    z = F.when(enough & (error > 0), (F.col("mean_b") - F.col("mean_a")) / error)
    tested = stats.withColumn("lift", lift).withColumn("z", z).withColumn("p_value", F.coalesce(two_sided_p("z"), F.lit(1.0)))
    tested = tested.withColumn("significant", F.col("p_value") < alpha)
    return tested.withColumn("gate_passed", F.col("significant") & (F.col("lift") >= mde))


def release_gate(gate: Column, fairness: Column, causal: Column) -> Column:
    return gate & fairness & causal
