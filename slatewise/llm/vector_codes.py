"""Vector codes by product quantisation, the codebooks fitted by a dual-tree form of Lloyd's rounds in integers.

Vectors become integers and are cut into parts. Blocks of vectors carry a tree over each of their parts; every node knows its
box, count and sum. In a round the trees of a block meet a tree over the part's codebook entries: bounds on the distance of
two boxes drop combinations that cannot be nearest, a node left with one entry gives it its cached count and sum whole, and
only in leaves that stay uncertain are distances of single parts computed. Blocks are rows of a stored table; what leaves a
round are sums per entry, which Spark adds up.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slatewise.llm.common import stored
from slatewise.operators.scale import bounded_broadcast

#: Vectors of a block, and parts of a leaf, at most.
BLOCK, LEAF = 2048, 16
SCALE = 4096


@dataclass
class Trees:
    """Trees over groups of points as one set of nodes: the root of each group, children (-1 in leaves), the points [start,
    end) below a node in tree order, and per node box, sum of points and group."""

    order: np.ndarray
    roots: np.ndarray
    children: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> "Trees":
        with np.load(io.BytesIO(data)) as arrays:
            return Trees(**arrays)


def grow(points: np.ndarray, groups: list[tuple[int, int]], leaf: int) -> Trees:
    """A tree over the points of each group [start, end), split in the middle of the widest side down to ``leaf`` points."""
    order = np.arange(len(points))
    nodes: list[tuple[int, int]] = []
    children: list[tuple[int, int]] = []
    roots = []
    for start, end in groups:
        roots.append(len(nodes))
        nodes.append((start, end))
        children.append((-1, -1))
        work = [roots[-1]]
        while work:
            node = work.pop()
            a, b = nodes[node]
            if b - a <= leaf:
                continue
            inside = points[order[a:b]]
            side = int((inside.max(axis=0) - inside.min(axis=0)).argmax()) if inside.shape[1] else 0
            middle = (b - a) // 2
            if inside.shape[1]:
                order[a:b] = order[a:b][np.argpartition(inside[:, side], middle)]
            children[node] = (len(nodes), len(nodes) + 1)
            work += children[node]
            nodes += [(a, a + middle), (a + middle, b)]
            children += [(-1, -1), (-1, -1)]
    starts, ends = (np.array(x, dtype=np.int64) for x in zip(*nodes))
    laid = points[order]
    sums = np.concatenate([np.zeros((1, laid.shape[1]), np.int64), np.cumsum(laid, axis=0, dtype=np.int64)])
    low = np.array([laid[a:b].min(axis=0) for a, b in nodes]).reshape(len(nodes), -1)
    high = np.array([laid[a:b].max(axis=0) for a, b in nodes]).reshape(len(nodes), -1)
    return Trees(order, np.array(roots), np.array(children), starts, ends, low, high, sums[ends] - sums[starts])


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def nearest(points: np.ndarray, of: Trees, entries: np.ndarray, codebook: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assign every point to the nearest entry of its group: (nodes, their entries) assigned whole, and (points in tree
    order, their entries) assigned one by one. Entries are numbered over all groups; ties go to the lower number."""
    a, b = of.roots, codebook.roots
    whole: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    single = list(whole)
    while len(a):
        gap = np.maximum(np.maximum(of.low[a] - codebook.high[b], codebook.low[b] - of.high[a]), 0)
        span = np.maximum(of.high[a] - codebook.low[b], codebook.high[b] - of.low[a])
        least, most = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        best = np.minimum.reduceat(most, firsts)
        sizes = np.diff(np.r_[firsts, len(a)])
        kept = least <= np.repeat(best, sizes)
        a, b = a[kept], b[kept]
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[firsts, len(a)])
        entry_leaf = codebook.children[b, 0] < 0
        settled = (sizes == 1) & entry_leaf[firsts]
        whole.append((a[firsts[settled]], codebook.order[codebook.starts[b[firsts[settled]]]]))
        uncertain = (of.children[a[firsts], 0] < 0) & np.logical_and.reduceat(entry_leaf, firsts) & ~settled
        pairs = np.repeat(uncertain, sizes)
        if pairs.any():
            node, entry = a[pairs], codebook.order[codebook.starts[b[pairs]]]
            lengths = of.ends[node] - of.starts[node]
            point, entry = _spans(of.starts[node], lengths), np.repeat(entry, lengths)
            apart = ((points[of.order[point]] - entries[entry]) ** 2).sum(axis=1)
            by = np.lexsort((entry, apart, point))
            take = by[np.r_[True, point[by][1:] != point[by][:-1]]]
            single.append((point[take], entry[take]))
        on = ~np.repeat(settled | uncertain, sizes)
        a, b = a[on], b[on]
        # Both sides of a combination go down; a leaf stays as it is.
        below = lambda tree, x: (np.where(tree.children[x, 0] < 0, x, tree.children[x, 0]), tree.children[x, 1])
        (a0, a1), (b0, b1) = below(of, a), below(codebook, b)
        a = np.concatenate([a0, a0, a1, a1])
        b = np.concatenate([b0, b1, b0, b1])
        real = (a >= 0) & (b >= 0)
        a, b = a[real], b[real]
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
    return tuple(np.concatenate([pair[i] for pair in found]) for found in (whole, single) for i in (0, 1))


def entry_trees(codebooks: np.ndarray) -> tuple[np.ndarray, Trees]:
    """The entries of all parts below one another, and a tree over those of each part."""
    parts, size, width = codebooks.shape
    entries = codebooks.reshape(parts * size, width)
    return entries, grow(entries, [(p * size, (p + 1) * size) for p in range(parts)], 1)


def _parts_of(vectors: np.ndarray, parts: int) -> np.ndarray:
    """The first part of every vector, then the second of every vector, and so on."""
    return vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2).reshape(parts * len(vectors), -1)


def block_sums(points: np.ndarray, trees: Trees, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points that each entry gets."""
    entries, codebook = entry_trees(codebooks)
    nodes, given, single, chosen = nearest(points, trees, entries, codebook)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    np.add.at(counts, given, trees.ends[nodes] - trees.starts[nodes])
    np.add.at(sums, given, trees.sums[nodes])
    np.add.at(counts, chosen, 1)
    np.add.at(sums, chosen, points[trees.order[single]])
    return counts.reshape(codebooks.shape[:2]), sums.reshape(codebooks.shape)


def block_codes(points: np.ndarray, trees: Trees, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes (vectors x parts) and squared distances summed over the parts."""
    parts, size, _ = codebooks.shape
    entries, codebook = entry_trees(codebooks)
    nodes, given, single, chosen = nearest(points, trees, entries, codebook)
    codes = np.empty(len(points), np.int64)
    lengths = trees.ends[nodes] - trees.starts[nodes]
    codes[trees.order[_spans(trees.starts[nodes], lengths)]] = np.repeat(given, lengths)
    codes[trees.order[single]] = chosen
    errors = ((points - entries[codes]) ** 2).sum(axis=1)
    return (codes.reshape(parts, -1) % size).T, errors.reshape(parts, -1).sum(axis=0)


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, label, code (an array of entry indexes) and error; ``codebooks``: parts x entries x width."""

    rows: DataFrame
    codebooks: np.ndarray


def _kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``v``, the integer components, of vectors without null or non-finite components."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    limit = F.sqrt(2.0**62 / F.greatest(F.size("embedding"), F.lit(1))) / 2
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < limit))
    given = vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & fine)
    return given.select("vec_id", "label", F.transform(wide, lambda x: F.floor(x * SCALE)).alias("v"))


def compress(vectors: DataFrame, parts: int = 8, size: int = 16, rounds: int = 6) -> Codes:
    """Codes of all ``vectors`` (vec_id, embedding, label) and the codebooks that ``rounds`` rounds over them give.

    Component x counts as the integer floor(4096 * x). Codebooks begin with the parts of the ``size`` smallest vec_ids (ties by
    the vector itself, rows without vec_id last), or of all rows where there are fewer. An entry that gets nothing stays; else
    it becomes the floor of its parts' mean, component by component.

    Dropped are rows whose vector is null, holds null or non-finite components, has another length than that of the smallest
    vec_id, or has components so large that squared distances could leave 64 bits (32,768 and more, at 64 components). A
    length that the parts don't divide is filled up with zeros. Repeated rows are coded each; an empty table gives no rows.
    Other columns are ignored. The driver holds codebooks, never vectors.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors)
    first = [row["v"] for row in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).select("v").collect()]
    length = len(first[0]) if first else 0
    first = [v for v in first if len(v) == length]
    width = -(-length // parts)
    label_type = kept.schema["label"].dataType

    def filled(rows: list) -> np.ndarray:
        flat = np.array(rows, dtype=np.int64).reshape(len(rows), length)
        return np.pad(flat, ((0, 0), (0, parts * width - length)))

    block_kind = T.StructType().add("vec_ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(label_type)).add("v", T.BinaryType()).add("trees", T.BinaryType())
    block_arrow = to_arrow_schema(block_kind)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task in blocks, each with its trees."""
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                ids, labels, rows = (batch.slice(start, BLOCK).column(i) for i in range(3))
                vectors = filled(rows.to_pylist())
                trees = grow(_parts_of(vectors, parts), [(p * len(vectors), (p + 1) * len(vectors)) for p in range(parts)], LEAF)
                values = [[ids.to_pylist()], [labels.to_pylist()], [vectors.tobytes()], [trees.pack()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, block_arrow)], schema=block_arrow)

    same = kept.filter(F.size("v") == length).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v")
    blocks = stored(same.mapInArrow(lay, block_kind), "vector-blocks")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in range(batch.num_rows):
                trees = Trees.unpack(batch.column("trees")[row].as_py())
                vectors = np.frombuffer(batch.column("v")[row].as_py(), np.int64).reshape(len(batch.column("vec_ids")[row]), parts * width)
                yield batch, row, _parts_of(vectors, parts), trees

    codebooks = np.zeros((parts, len(first), width), np.int64)
    if first:
        codebooks[:] = _parts_of(filled(first), parts).reshape(parts, len(first), width)
    sums_schema = "entry int, position int, rows bigint, total bigint"

    def one_round(books: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for _, _, points, trees in opened(batches):
                more = block_sums(points, trees, books)
                counts, sums = counts + more[0], sums + more[1]
            entry, position = np.divmod(np.arange(sums.size, dtype=np.int32), max(width, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (entry.astype(np.int32), position.astype(np.int32), np.repeat(counts.ravel(), width), sums.ravel())], ["entry", "position", "rows", "total"])

        return blocks.mapInArrow(run, sums_schema).groupBy("entry", "position").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))

    for _ in range(rounds if codebooks.size else 0):
        flat = codebooks.copy().reshape(-1, width)
        for entry, position, count, total in one_round(codebooks).collect():  # as many rows as the codebooks have components
            if count:
                flat[entry, position] = total // count
        codebooks = flat.reshape(codebooks.shape)

    row_kind = T.StructType().add("vec_id", T.LongType()).add("label", label_type).add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    row_arrow = to_arrow_schema(row_kind)
    final = codebooks

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, points, trees in opened(batches):
            codes, errors = block_codes(points, trees, final) if width else (np.zeros((len(batch.column("vec_ids")[row]), parts), np.int64), np.zeros(len(batch.column("vec_ids")[row]), np.int64))
            columns = [batch.column("vec_ids")[row].as_py(), batch.column("labels")[row].as_py(), codes.tolist(), errors]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, row_arrow)], schema=row_arrow)

    return Codes(blocks.mapInArrow(encode, row_kind), codebooks)


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels, nulls together) and
    codebooks_sha256, of the codes that ``compress`` gives."""
    codes = compress(vectors)
    rows = stored(codes.rows, "vector-codes")
    by_label = bounded_broadcast(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    told = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    sha = hashlib.sha256(",".join(map(str, codes.codebooks.ravel().tolist())).encode()).hexdigest()
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", told.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
