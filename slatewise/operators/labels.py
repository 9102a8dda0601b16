"""Weights for labels that arrive late."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import expressions as X
from slatewise.operators.scale import BROADCAST_ROWS, HOT_GROUP_ROWS, running_sums

# Names of the strategies, and the default weights.
STRATEGIES = ("cdf", "survival_weighted", "defer", "defuse")


@dataclass(frozen=True)
class DelayWeights:
    floor: float = 0.05
    cap: float = 1.0
    survival_power: float = 1.5
    defer_power: float = 2.0
    defuse_alpha: float = 0.6


def delay_distribution(histogram: DataFrame, hot_rows: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """(max_hours, share, cdf, survival) from (max_hours, n), for any number of buckets."""
    grouped = histogram.groupBy("max_hours").agg(F.sum("n").cast("double").alias("n"))
    total = grouped.agg(F.sum("n").alias("__total"))  # one row
    share = F.when(F.col("__total") == 0.0, F.col("n")).otherwise(F.col("n") / F.col("__total"))
    shared = grouped.join(F.broadcast(total)).withColumn("share", share)
    summed = running_sums(shared, [], ["max_hours"], {"cdf": "share"}, hot_rows).withColumn("cdf", X.clip(F.col("cdf"), 0.0, 1.0))
    return summed.withColumn("survival", 1.0 - F.col("cdf")).select("max_hours", "share", "cdf", "survival")


def _reached(delays: DataFrame, distribution: DataFrame, hot_rows: int | None) -> DataFrame:
    """(delay_hours, __cdf) of every distinct delay: the share of the first bucket that holds it.

    The cumulated share never falls, so it is a running minimum over buckets from the longest to the shortest.
    """
    asked = delays.select(F.col("delay_hours").cast("double").alias("hours")).filter(F.col("hours").isNotNull()).distinct()
    buckets = distribution.select(F.col("max_hours").cast("double").alias("hours"), F.lit(0).alias("kind"), "cdf")
    both = buckets.unionByName(asked.select("hours", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("cdf"))).withColumn("__back", -F.col("hours"))
    met = running_sums(both, [], ["__back", "kind"], {"__cdf": "cdf"}, hot_rows, least=True)
    return met.filter("kind = 1").select(F.col("hours").alias("delay_hours"), "__cdf")


def shipped_share(distribution: DataFrame, most: int = BROADCAST_ROWS) -> Callable[[Column], Column] | None:
    """Looks up the cumulated share behind a delay in a histogram that travels with the tasks, so that nothing is joined or
    sorted and streams can ask as well. None when the histogram, which is counted, has more than ``most`` buckets.

    A delay is behind the first bucket that holds it; beyond the last bucket the whole mass is; an empty histogram has none.
    """
    rows = distribution.filter(F.col("max_hours").isNotNull()).select(F.col("max_hours").cast("double"), "cdf").limit(most + 1).collect()
    if len(rows) > most:
        return None
    rows.sort()
    borders = np.array([r[0] for r in rows])
    shares = np.array([r[1] for r in rows] or [0.0])

    @F.pandas_udf(T.DoubleType())
    def share(delays: pd.Series) -> pd.Series:
        return pd.Series(shares[np.minimum(np.searchsorted(borders, delays.to_numpy(dtype=float)), len(shares) - 1)])

    return share


def _weight(strategy: str, share: Column, config: DelayWeights) -> Column:
    survival = F.greatest(F.lit(0.0), 1.0 - share)
    by_survival = 1.0 - F.pow(survival, F.lit(max(config.survival_power, 0.0)))
    by_defer = F.pow(share, F.lit(max(config.defer_power, 0.0)))
    alpha = min(max(config.defuse_alpha, 0.0), 1.0)
    raw = {"cdf": share, "survival_weighted": by_survival, "defer": by_defer, "defuse": alpha * by_defer + (1.0 - alpha) * by_survival}[strategy]
    held = X.clip(raw, config.floor, config.cap)
    return F.when(F.col("label") == 1, 1.0).when(F.col("delay_hours").isNull(), config.floor).otherwise(held)


def _reason(strategy: str) -> Column:
    # Fixed output values.
    return F.when(F.col("label") == 1, "positive").when(F.col("delay_hours").isNull(), "missing_delay").otherwise(f"delayed_negative:{strategy}")


def adjust_by_strategies(
    labels: DataFrame, distribution: DataFrame, strategies: Sequence[str] = STRATEGIES, config: DelayWeights = DelayWeights(),
    hot_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per (label, delay_hours) and strategy, with strategy, weight and reason; the share is looked up once.

    Histograms of up to ``hot_rows`` buckets travel with the tasks. Larger ones meet the distinct delays in a running
    minimum; on a stream they are an error.
    """
    names = [s.strip().lower() for s in strategies]
    for name, given in zip(names, strategies):
        if name not in STRATEGIES:
            raise ValueError(f"unsupported delayed feedback strategy: {given}")
    labels = labels.withColumn("delay_hours", F.col("delay_hours").cast("double"))
    look_up = shipped_share(distribution, hot_rows)
    if look_up is not None:
        joined = labels.withColumn("__cdf", look_up(F.col("delay_hours")))
    elif labels.isStreaming:
        raise ValueError(f"a stream takes at most {hot_rows} buckets of delays")
    else:
        last = distribution.agg(F.max("cdf").alias("__last"))  # one row
        reached = _reached(labels, distribution, hot_rows)
        joined = labels.join(reached, "delay_hours", "left").select(*labels.columns, "__cdf").join(F.broadcast(last))
        joined = joined.withColumn("__cdf", F.coalesce("__cdf", "__last", F.lit(0.0))).drop("__last")
    each = [F.struct(F.lit(n).alias("strategy"), _weight(n, F.col("__cdf"), config).alias("weight"), _reason(n).alias("reason")) for n in names]
    return joined.select(*labels.columns, F.inline(F.array(*each)))


def adjust_labels(labels: DataFrame, distribution: DataFrame, strategy: str = "cdf", config: DelayWeights = DelayWeights(), hot_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds weight and reason to (label, delay_hours). A delay beyond the last bucket has the whole mass behind it."""
    return adjust_by_strategies(labels, distribution, (strategy,), config, hot_rows).drop("strategy")


def survival_weight(label: Column, elapsed: Column, rate: float = 0.1) -> Column:
    """1 for positives; for negatives the inverse of exp(-rate * elapsed), which is clipped to [1e-6, 1]."""
    return F.when(label > 0, 1.0).otherwise(1.0 / X.clip(F.exp(-elapsed * rate), 1e-6, 1.0))


def delays_from_events(
    events: DataFrame, start: tuple[str, ...], goal: tuple[str, ...], user: str = "user_id", time: str = "ts", hot_rows: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """(user, event_id, started, delay_hours, label) for each start event: hours to the user's next goal event, or null.

    The next goal is a running minimum over the user's events from the end, so nothing is joined.
    """
    if set(start) & set(goal):
        raise ValueError("an event type cannot be both start and goal")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    timed = events.filter(F.col("event_type").isin(*start, *goal)).withColumn("__at", micros)
    timed = timed.withColumn("__goal", F.when(F.col("event_type").isin(*goal), F.col("__at"))).withColumn("__back", -F.col("__at")).withColumn("__id", -F.col("event_id"))
    marked = running_sums(timed, [user], ["__back", "__id"], {"__next": "__goal"}, hot_rows, least=True)
    return marked.filter(F.col("event_type").isin(*start)).select(
        user, "event_id", F.col(time).alias("started"), ((F.col("__next") - F.col("__at")) / 3.6e9).alias("delay_hours"), F.col("__next").isNotNull().cast("int").alias("label")
    )
