"""Geometry of an embedding table: alignment, uniformity, anisotropy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.scale import HOT_GROUP_ROWS, by_shuffle, numbered
from slatewise.session import written


def alignment(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean squared distance of positive pairs on unit vectors. ``vectors``: id, vector; ``pairs``: a, b."""
    unit = vectors.select("id", X.unit_vector(F.col("vector")).alias("u"))
    joined = pairs.join(unit.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a").join(unit.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b")
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg(X.squared_distance(F.col("ua"), F.col("ub"))), F.lit(0.0)).alias("alignment"))


# Vectors of a block, and those of its rows whose distances are computed at once.
BLOCK, AT_ONCE = 2048, 256
# Bytes of blocks, about, that a task reads again and again while its own blocks pass.
PASSED_BYTES = 64_000_000


def uniformity(vectors: DataFrame, partners: int | None = None, hot_rows: int | None = HOT_GROUP_ROWS, block: int = BLOCK) -> DataFrame:
    """log mean exp(-2 d^2) over all pairs of unit vectors. ``vectors``: id (unique), vector.

    A vector with a null has no distance to any other, nor have two of different length. With ``partners`` every row is paired
    only with as many rows that follow it on a ring, see ``_over_ring``.
    """
    return _over_all(vectors, block) if partners is None else _over_ring(vectors, partners, hot_rows, block)


def _over_all(vectors: DataFrame, block: int) -> DataFrame:
    """Equal vectors are one, with its number of rows. Blocks of vectors, written once as bytes, meet in tasks that hold a bounded
    part of them; nothing is shuffled for that. The work is every distinct vector against every other."""
    spark = vectors.sparkSession
    rows = vectors.agg(F.count(F.lit(1)).alias("rows"))
    total = rows.first()[0]
    if total < 2:
        return rows.withColumn("uniformity", F.lit(0.0))
    whole = vectors.filter(F.forall("vector", lambda x: x.isNotNull())).select(X.unit_vector(F.col("vector")).alias("u"))
    folded = written(whole.groupBy("u").agg(F.count(F.lit(1)).alias("times")), "folded").withColumn("width", F.size("u"))
    many, widest = folded.agg(F.count(F.lit(1)), F.max("width")).first()
    blocks = max(1, -(-many // block))

    def pack(held: pa.Table) -> pa.Table:
        first = lambda name: held.column(name)[:1].combine_chunks()
        flat = held.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (flat, held.column("times").to_numpy())]
        return pa.table([first("block"), first("width"), *packed], names=["block", "width", "u", "times"])

    dealt = folded.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)))
    packed = written(dealt.groupBy("block", "width").applyInArrow(pack, "block long, width int, u binary, times binary"), "blocks")
    cores = spark.sparkContext.defaultParallelism
    mine = packed.repartition(min(blocks, 4 * cores))
    theirs = packed.coalesce(max(1, -(-many * 8 * (widest or 1) // PASSED_BYTES))).toDF("other", "other_width", "other_u", "other_times")
    # Each block with itself and with the half of the others that follow it in a circle, so that all have as many to meet.
    ahead = F.pmod(F.col("other") - F.col("block"), F.lit(blocks))
    turn = (2 * ahead < blocks) | ((2 * ahead == blocks) & (F.col("block") < F.col("other")))
    met = mine.join(theirs.hint("shuffle_replicate_nl"), (F.col("width") == F.col("other_width")) & turn)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            summed, pairs = 0.0, 0
            for i in range(len(batch)):
                number, width, other = [batch.column(c)[i].as_py() for c in ("block", "width", "other")]
                n, m = [np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.int64) for c in ("times", "other_times")]
                a, b = [np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(k), width) for c, k in (("u", n), ("other_u", m))]
                long_a, long_b = [2.0 * np.einsum("ij,ij->i", x, x) for x in (a, b)]
                here = alone = 0.0
                for start in range(0, len(a), AT_ONCE):
                    part = slice(start, start + AT_ONCE)
                    near = 4.0 * (a[part] @ b.T) - long_a[part, None] - long_b
                    np.exp(np.minimum(near, 0.0, out=near), out=near)
                    here += n[part] @ (near @ m)
                    alone += n[part] @ near[np.arange(len(near)), start + np.arange(len(near))] if number == other else 0.0
                all_pairs = int(n.sum()) * int(m.sum())
                summed += (here - alone) / 2.0 if number == other else here
                pairs += (all_pairs - int(n.sum())) // 2 if number == other else all_pairs
            yield pa.RecordBatch.from_arrays([pa.array([summed]), pa.array([pairs], pa.int64())], ["summed", "pairs"])

    sums = met.mapInArrow(meet, "summed double, pairs long")
    mean = F.sum("summed") / F.nullif(F.sum("pairs"), F.lit(0))
    return sums.agg(F.lit(total).cast("long").alias("rows"), F.log(mean).alias("uniformity"))


def _over_ring(vectors: DataFrame, partners: int, hot_rows: int | None, block: int) -> DataFrame:
    """The mean over every row with the ``partners`` rows that follow it on a ring.

    The ring is the order of the ids' MD5, so partners are as good as drawn at random, every row counts equally, and the work
    grows with the rows; with at most ``partners`` + 1 rows it is the mean over all pairs.

    Only ids are numbered. Blocks of the ring meet the rows that follow theirs, so a vector travels about twice.
    """
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
    placed = written(numbered(vectors.select("id", draw.alias("draw")), [], ["draw", "id"], "place", hot_rows).select("id", (F.col("place") - 1).alias("place")), "ring")
    rows = placed.agg(F.count(F.lit(1)).alias("rows"))
    total = rows.first()[0]
    steps = min(partners, total - 1)
    if steps < 1:
        return rows.withColumn("uniformity", F.lit(0.0))
    # A vector with a null has no distance to any other.
    whole = vectors.filter(F.forall("vector", lambda x: x.isNotNull())).withColumn("u", X.unit_vector(F.col("vector")))
    ring = placed.join(by_shuffle(whole.select("id", "u")), "id").select("place", "u")
    home = lambda place: F.floor(place / block)
    before = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: home(F.pmod(F.col("place") - s, F.lit(total))))
    mine = ring.withColumn("block", home(F.col("place"))).toDF("place", "u", "block")
    theirs = ring.withColumn("block", F.explode(F.array_distinct(before))).toDF("place", "u", "block")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        summed, pairs = 0.0, 0
        if len(left) and len(right):
            right = right.sort_values("place")
            places, width = right["place"].to_numpy(), max(left["u"].map(len).max(), right["u"].map(len).max())
            fit = lambda u: np.stack([np.pad(v, (0, width - len(v))) for v in u])
            a, b, size_a, size_b = fit(left["u"]), fit(right["u"]), left["u"].map(len).to_numpy(), right["u"].map(len).to_numpy()
            for step in range(1, steps + 1):
                wanted = (left["place"].to_numpy() + step) % total
                at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                held = (places[at] == wanted) & (size_a == size_b[at])
                gap = a[held] - b[at[held]]
                summed += np.exp(-2.0 * np.einsum("ij,ij->i", gap, gap)).sum()
                pairs += int(held.sum())
        return pd.DataFrame({"summed": [summed], "pairs": [pairs]})

    met = mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInPandas(meet, "summed double, pairs long")
    return met.agg(F.lit(total).cast("long").alias("rows"), F.log(F.sum("summed") / F.sum("pairs")).alias("uniformity"))


def anisotropy(vectors: DataFrame) -> DataFrame:
    """First singular value of the centred unit vectors over the sum of all."""
    dim = vectors.select(F.max(F.size("vector"))).first()[0]
    unit = vectors.select(array_to_vector(X.unit_vector(F.col("vector"))).alias("u"))
    ratios = PCA(k=dim, inputCol="u", outputCol="p").fit(unit).explainedVariance.toArray()
    roots = [math.sqrt(max(0.0, float(r))) for r in ratios]
    value = roots[0] / sum(roots) if sum(roots) > 0 else 0.0
    return vectors.sparkSession.createDataFrame([(int(dim), value)], "dimension long, anisotropy double")
