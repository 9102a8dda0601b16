"""Exploration: reward state per item and selection from a slate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.scale import by_shuffle, top_n_per_group


def beta_state(rewards: DataFrame, prior_alpha: float = 1.0, prior_beta: float = 1.0) -> DataFrame:
    """alpha grows by positive rewards, beta by one for every other event. Works on a stream too."""
    return rewards.groupBy("item_id").agg(
        (F.lit(prior_alpha) + F.sum(F.when(F.col("reward") > 0, F.col("reward")).otherwise(0.0))).alias("alpha"),
        (F.lit(prior_beta) + F.sum(F.when(F.col("reward") > 0, 0.0).otherwise(1.0))).alias("beta"),
    )


def ucb_state(rewards: DataFrame) -> DataFrame:
    """Pulls and mean reward per item."""
    return rewards.groupBy("item_id").agg(F.count(F.lit(1)).alias("pulls"), F.avg("reward").alias("mean_reward"))


def ucb_select(candidates: DataFrame, state: DataFrame, k: int, exploration: float = math.sqrt(2.0)) -> DataFrame:
    """Half score, half optimistic reward bound (at most 1; 1 for unseen items). Without any pull the input order stays."""
    pulls = state.agg(F.coalesce(F.sum("pulls"), F.lit(0)).alias("total_pulls"))
    joined = candidates.join(by_shuffle(state), "item_id", "left").join(F.broadcast(pulls))
    bound = F.coalesce(
        F.least(F.col("mean_reward") + exploration * F.sqrt(F.log(F.col("total_pulls").cast("double")) / F.col("pulls")), F.lit(1.0)),
        F.lit(1.0),
    )
    blended = F.when(F.col("total_pulls") == 0, 0.0).otherwise(0.5 * F.col("score") + 0.5 * bound)
    return top_n_per_group(joined.withColumn("blended_score", blended), ["query_id"], [F.col("blended_score").desc(), F.col("pos")], k)


def _seed_words(seeds: np.ndarray) -> np.ndarray:
    """What ``SeedSequence(seed).generate_state(4, np.uint64)`` gives for each 64-bit seed, for all seeds at once."""
    const = 0x43B0D7E5

    def hashed(value: np.ndarray, factor: int) -> np.ndarray:
        nonlocal const
        value = value ^ np.uint32(const)
        const = const * factor & 0xFFFFFFFF
        value = value * np.uint32(const)
        return value ^ (value >> np.uint32(16))

    low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
    pool = [hashed(word, 0x931E8875) for word in (low, high, np.zeros_like(low), np.zeros_like(low))]
    for source in range(4):
        for target in range(4):
            if source != target:
                mixed = pool[target] * np.uint32(0xCA01F9DD) - hashed(pool[source], 0x931E8875) * np.uint32(0x4973F715)
                pool[target] = mixed ^ (mixed >> np.uint32(16))
    const = 0x8B51F9DD
    words = np.stack([hashed(pool[i % 4], 0x58F38DED) for i in range(8)], axis=1).astype("<u4")
    return np.ascontiguousarray(words).view("<u8").astype(np.uint64)


def beta_draws(keys: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """``default_rng(key).beta(alpha, beta)`` of each row; the seeds, most of the cost, are spread out for all rows at once."""

    class Words(np.random.bit_generator.ISeedSequence):
        def generate_state(self, n_words, dtype=np.uint32):
            return self.words

    source, out = Words(), np.empty(len(keys))
    for i, (words, a, b) in enumerate(zip(_seed_words(keys.astype(np.uint64)), alpha.tolist(), beta.tolist())):
        source.words = words
        out[i] = np.random.Generator(np.random.PCG64(source)).beta(a, b)
    return out


def thompson_select(candidates: DataFrame, state: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """0.7 score + 0.3 Beta draw. The draw depends only on seed, query and item, so a re-run gives the same slate."""

    @F.pandas_udf("double")
    def draw(key: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series(beta_draws(key.to_numpy() & 0x7FFFFFFFFFFFFFFF, alpha.to_numpy(), beta.to_numpy()))

    has_state = state.limit(1).count() > 0
    joined = candidates.join(by_shuffle(state), "item_id", "left").fillna(1.0, ["alpha", "beta"])
    if has_state:
        key = F.xxhash64(F.lit(seed), F.col("query_id").cast("string"), F.col("item_id").cast("string"))
        blended = 0.7 * F.col("score") + 0.3 * draw(key, F.col("alpha"), F.col("beta"))
    else:
        blended = F.col("score")
    return top_n_per_group(joined.withColumn("blended_score", blended), ["query_id"], [F.col("blended_score").desc(), F.col("pos")], k)


def epsilon_greedy_select(candidates: DataFrame, k: int, epsilon: float = 0.05, seed: int = 7) -> DataFrame:
    """Per slate: with probability epsilon a uniform shuffle, else best by score. Coins and shuffles are drawn by MD5."""
    coin = X.hex_number(seed, F.lit("coin"), "query_id") / F.lit(float(16**15))
    mixed = X.hex_number(seed, "query_id", "item_id", "pos").cast("double")
    explored = candidates.withColumn("explored", coin < epsilon)
    key = F.when(F.col("explored"), mixed).otherwise(-F.col("score"))
    return top_n_per_group(explored.withColumn("__key", key), ["query_id"], [F.col("__key"), F.col("pos")], k).drop("__key")
