"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random into a few times its dimensions and kept as one bit a dimension, with the inner product of
vector and code as correction. The inner product with a query is estimated from the bits alone; its error bound decides which
vectors can still be among the nearest, and these are ranked by the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatewise.llm.common import stored


@dataclass(frozen=True)
class Codes:
    """``expand`` bits per dimension; ``sigmas`` is how many standard errors an estimate may be off (at 4, about one bound
    in 30,000 is broken); block sizes bound what one task holds."""

    expand: int = 4
    sigmas: float = 4.0
    query_block: int = 1024
    item_block: int = 8192
    slice: int = 2048


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, bits: int) -> np.ndarray:
    """``bits`` x ``dim`` with orthonormal columns, the same wherever it is made."""
    if (dim, bits) not in _ROTATIONS:
        _ROTATIONS[dim, bits] = np.linalg.qr(np.random.default_rng(dim).standard_normal((bits, dim)))[0]
    return _ROTATIONS[dim, bits]


def bits_for(dim: int, expand: int) -> int:
    return -(-dim * expand // 8) * 8


def encode(vectors: np.ndarray, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits and corrections of unit vectors."""
    turned = vectors @ rotation(vectors.shape[1], bits_for(vectors.shape[1], expand)).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(packed: np.ndarray, correction: np.ndarray, queries: np.ndarray, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and, per vector, the standard error of its estimates."""
    bits = bits_for(queries.shape[1], expand)
    signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(queries.shape[1], bits).T).astype(np.float32)
    error = np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(bits - 1)
    return turned @ signs.T / np.sqrt(bits) / correction[None, :], error


def usable(vector: str) -> Column:
    """Not null or empty, and every component a finite number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def index(vectors: DataFrame, expand: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stored index of every vector that takes part: row (a number of its own), vec_id, dim, norm, the vector as bytes,
    its packed bits and its correction. Null, empty, zero and non-finite vectors, and rows without vec_id, take no part."""
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    schema = "row bigint, vec_id bigint, dim int, norm double, vector binary, bits binary, correction double"
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            width = np.array(lists.value_lengths())
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(width):
                of = np.flatnonzero(width == dim)
                plain = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), dim)
                norm = np.sqrt((plain**2).sum(axis=1))
                good = np.flatnonzero((norm > 0) & np.isfinite(norm))
                of, plain, norm = of[good], plain[good], norm[good]
                packed, correction = encode(plain / norm[:, None], expand)
                rows_of = lambda matrix: pa.array([r.tobytes() for r in matrix], pa.binary())
                columns = [pa.array(rows[of]), pa.array(ids[of].astype(np.int64)), pa.array(np.full(len(of), dim), pa.int32()), pa.array(norm), rows_of(plain), rows_of(packed), pa.array(correction)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return stored(chosen.filter(F.col("vec_id").isNotNull() & usable("v")).mapInArrow(run, schema), "codes")


class _Best:
    """The k best candidates so far of every query of a block; ties go to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        self.q, self.ids, self.score = (x[place < self.k] for x in (q, ids, score))
        last = place == self.k - 1
        self.floor[q[last]] = score[last]


def _search_block(queries: pd.DataFrame, items: pd.DataFrame, k: int, codes: Codes) -> pd.DataFrame:
    matrix = lambda column, kind, rows: np.frombuffer(b"".join(column), kind).reshape(rows, -1)
    best = _Best(len(queries), k)
    if len(queries) and len(items):
        qv, qid, qnorm = matrix(queries["vector"], np.float64, len(queries)), queries["vec_id"].to_numpy(), queries["norm"].to_numpy()
        unit = qv / qnorm[:, None]
        for start in range(0, len(items), codes.slice):
            part = items.iloc[start : start + codes.slice]
            iv, ids, norm = matrix(part["vector"], np.float64, len(part)), part["vec_id"].to_numpy(), part["norm"].to_numpy()
            guess, error = estimate(matrix(part["bits"], np.uint8, len(part)), part["correction"].to_numpy(), unit, codes.expand)
            slack = codes.sigmas * error[None, :]
            other = qid[:, None] != ids[None, :]
            low = np.where(other, guess - slack, -np.inf)
            floor = best.floor
            if len(part) >= k:
                floor = np.maximum(floor, np.partition(low, len(part) - k, axis=1)[:, len(part) - k])
            q, i = np.nonzero(other & (guess + slack >= floor[:, None]))
            for at in range(0, len(q), 200_000):
                a, b = q[at : at + 200_000], i[at : at + 200_000]
                best.add(a, ids[b], (qv[a] * iv[b]).sum(axis=1) / (qnorm[a] * norm[b]))
    return pd.DataFrame({"query_row": queries["row"].to_numpy()[best.q], "query_id": queries["vec_id"].to_numpy()[best.q], "vec_id": best.ids, "score": best.score})


def search(indexed: DataFrame, queries: Column, k: int = 5, codes: Codes = Codes()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine of the original vectors) of the ``k`` nearest of every query row.

    ``queries`` picks rows of the index. Queries and vectors are dealt into blocks, and each pair of blocks meets in one
    task that gives back k rows a query. Vectors of other dimensions, and those with the query's own id, are no candidates;
    of fewer than k candidates all are returned; rows that repeat a query's id are queries of their own.
    """
    asked = indexed.filter(queries)
    items, batch = indexed.count(), asked.count()
    item_blocks = max(-(-items // codes.item_block), 4 * indexed.sparkSession.sparkContext.defaultParallelism)
    query_blocks = max(1, -(-batch // codes.query_block))
    spread = lambda other, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(other)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n).cast("long"))
    left = asked.select("dim", "row", "vec_id", "norm", "vector", deal(query_blocks).alias("qb"), spread("ib", item_blocks))
    right = indexed.select("dim", "vec_id", "norm", "vector", "bits", "correction", deal(item_blocks).alias("ib"), spread("qb", query_blocks))
    on = ["dim", "qb", "ib"]
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(lambda q, i: _search_block(q, i, k, codes), "query_row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
