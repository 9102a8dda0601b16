"""Building blocks that keep every operator distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slatewise.session import written

# Spark prunes ``row_number() <= n`` before the shuffle up to this n (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_PUSHDOWN = 1000
# A window over a group up to this size is sorted by one task without trouble.
HOT_GROUP_ROWS = 2_000_000
# Rows are laid out in no more ranges than this while a range stays below half of HOT_GROUP_ROWS: every range is a task, with its
# results and samples on the driver.
LAID_RANGES = 256
# Tables up to this many rows may be broadcast; the count is checked, not assumed.
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows; else leave the join to shuffle."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: Spark would judge it by its compressed size, a small part of what a broadcast
    takes on the driver, so the join is told to sort and merge."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores when it has fewer splits than cores, before heavy per-row work.

    On a large table there are more splits than cores and nothing is moved. Splits beyond the file's row groups are empty,
    so a scan counts as narrow below four splits per core.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(2 * cores)


def spread_by(df: DataFrame, *columns: str) -> DataFrame:
    """Partition by ``columns`` over all cores, where a shuffle by them follows anyway and heavy per-row work after it: small
    shuffles are otherwise merged into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *columns)


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """First ``n`` rows of each group, numbered from 1.

    Up to 1000 Spark cuts each map task's share to ``n`` rows before the shuffle, so a hot key costs n rows per task.
    Beyond that the same is done by hand: rank inside salted sub-groups, keep ``n`` of each, then rank again.
    """
    if n > GROUP_LIMIT_PUSHDOWN:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts)))
        inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = salted.withColumn("__rn", F.row_number().over(inner)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(outer).cast("long")).filter(F.col(rank_col) <= n)


def _hashable(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, T.MapType)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"__r_{key}"])
    return condition


def _folded(df: DataFrame, window, sums: dict[str, str], fold) -> DataFrame:
    for name, source in sums.items():
        df = df.withColumn(name, fold(source).over(window))
    return df


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    hot_rows: int | None = HOT_GROUP_ROWS,
    least: bool = False,
) -> DataFrame:
    """Inclusive running sums (or, with ``least``, running minima) per group along ``order`` (columns, ascending, unique
    within a group).

    ``sums`` maps output column to input column. A plain window does this with one task per group. When a group is larger
    than ``hot_rows``, all rows are laid out by ranges of (keys, order) instead, see ``_running_over_ranges``. The result
    is the same either way. ``hot_rows=None`` skips the size check where the caller has already cut every group to a few
    rows.
    """
    keys = list(keys)
    fold = F.min if least else F.sum
    work = df
    if not keys:
        work = df.withColumn("__all", F.lit(0))
        keys = ["__all"]
    if hot_rows is not None:
        sizes = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        largest, rows = sizes.agg(F.max("__n"), F.sum("__n")).first()
        if (largest or 0) > hot_rows:
            ranges = min(ranges_of(rows, hot_rows), max(LAID_RANGES, ranges_of(rows, HOT_GROUP_ROWS)))
            return _running_over_ranges(work, keys, order, sums, fold, ranges).select(*df.columns, *sums)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _folded(work, window, sums, fold).drop("__all")


def ranges_of(rows: int, hot_rows: int) -> int:
    """How many ranges ``rows`` are laid out in: two for every ``hot_rows`` rows, since sampled borders are uneven."""
    return max(2, -(-2 * rows // hot_rows))


def _running_over_ranges(work: DataFrame, keys: list[str], order: Sequence[str], sums: dict[str, str], fold, ranges: int) -> DataFrame:
    """Running folds of groups of any size: tasks grow with the rows, not with the groups.

    Spark samples the borders of ``ranges`` ranges of (keys, order). The ranges are written once, so that a lost task finds
    the same ones, and each is folded for itself. A group that crosses a border is the last of one range and the first of
    the next; so one row per range (its first group, its last group and what that has summed up to) is enough to carry
    every group on.
    """
    laid = written(work.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = _folded(laid, local, sums, fold)

    group = F.struct(*keys)
    totals = laid.groupBy("__range", *keys).agg(*[fold(source).alias(name) for name, source in sums.items()])
    edges = totals.groupBy("__range").agg(
        F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(F.struct(*sums), group).alias("total")
    )
    ends = edges.select("__range", "last.*", *[F.col("total")[name].alias(name) for name in sums])
    starts = edges.filter(~F.col("first").eqNullSafe(F.col("last"))).select("__range", "first.*")
    carried = ends.unionByName(starts, allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carries = carried.select(
        F.col("__range").alias("__r_range"),
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[fold(name).over(earlier).alias(f"__o_{name}") for name in sums],
    )
    # At most two rows per range.
    small = F.broadcast(carries) if 2 * ranges <= BROADCAST_ROWS else carries
    joined = placed.join(small, (placed["__range"] == small["__r_range"]) & _same_keys(placed, small, keys), "left")
    for name in sums:
        mine, before = F.col(name), F.col(f"__o_{name}")
        # A range or a prefix holding only nulls has no value yet.
        both = F.least(mine, before) if fold is F.min else F.when(mine.isNull(), before).otherwise(mine + F.coalesce(before, F.lit(0)))
        joined = joined.withColumn(name, both)
    return joined


def settle(df: DataFrame, keys: Sequence[str], hot_rows: int | None) -> int | None:
    """``hot_rows`` when some group is larger, else None: one check for several calls that share their keys."""
    if hot_rows is None:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return hot_rows if sizes.filter(F.col("__n") > hot_rows).limit(1).count() else None


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "number", hot_rows: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """``row_number`` per group along numeric ascending ``order``, safe for groups of any size."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    return running_sums(counted, keys, order, {out: "__one"}, hot_rows=hot_rows).drop("__one")
