"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets a row of Hamming distances to reference fingerprints (pivots). Two fingerprints within r bits differ
by at most r in each of these distances, so a pair with a larger difference in some coordinate is discarded unseen, and only
survivors are compared bit by bit. Which pairs come into question at all is settled by bands: of five bands at least two are
equal in fingerprints that differ in at most three bits, so the pairs that share two bands lose no link. Copies fold into one
fingerprint first. A crowded pair of bands is dealt into cells of bounded size, and a cell reports a forest of its links,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from slatewise.llm.common import map_rows, stored, text_bytes
from slatewise.llm.components import connected_components

#: Shingle hashes turned into bits at once.
AT_ONCE = 1 << 16
#: Fingerprints of one side of a cell, about.
CELL = 512
#: Reference fingerprints.
PIVOTS = 32


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is 1 if it is set in more than half of the hashes of the text's word shingles. No word: zero."""
    found = text.lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not found:
        return 0
    columns = [found[i:] for i in range(words)] if len(found) >= words else [[w] for w in found]
    shingles = map(b" ".join, zip(*columns))
    total, ones = 0, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(s, 42) for s in shingles]
    for start in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[start : start + AT_ONCE], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long ``fp``; null text counts as empty."""

    def make():
        return lambda ids, texts: [(i, fingerprint(t, words)) for i, t in zip(ids, texts)]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), "doc_id bigint, fp bigint", make)


def band_masks(bits: int, shared: int) -> list[int]:
    """Masks of which two fingerprints that differ in at most ``bits`` bits agree on at least one: of ``bits + shared``
    bands, every choice of ``shared``."""
    count = bits + shared
    edges = [round(64 * i / count) for i in range(count + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(bands, shared)]


def pivot_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, count, dtype=np.uint64)


def links_of(fps: np.ndarray, distances: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within ``bits`` bits, from fingerprints and their pivot distances."""
    order = np.argsort(distances[:, 0], kind="stable")
    first = distances[order, 0].astype(np.int64)
    behind = np.searchsorted(first, first + bits, side="right") - np.arange(len(fps)) - 1
    left = np.repeat(np.arange(len(fps)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    left, right = order[left], order[right]
    for pivot in range(1, distances.shape[1]):
        if not len(left):
            break
        near = np.abs(distances[left, pivot].astype(np.int16) - distances[right, pivot]) <= bits
        left, right = left[near], right[near]
    near = np.bitwise_count(fps[left] ^ fps[right]) <= bits
    return left[near], right[near]


def _forest(fps: np.ndarray, distances: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its component in the cell) where they differ."""
    left, right = links_of(fps, distances, bits)
    order = np.argsort(fps.view(np.int64), kind="stable")
    place = np.empty(len(fps), dtype=np.int64)
    place[order] = np.arange(len(fps))
    a, b, label = place[left], place[right], np.arange(len(fps))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[order][moved], fps[order][label[moved]]


def fingerprint_links(distinct: DataFrame, bits: int = 3, shared: int = 2, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """Links (src, dst) that join distinct fingerprints ``fp`` into the components of "at most ``bits`` differing bits"."""
    masks = [np.uint64(m) for m in band_masks(bits, shared)]
    references = pivot_fingerprints(pivots)
    keyed_schema = "band int, key bigint, fp bigint, distances binary"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            near = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.uint8)
            tables = pa.array([row.tobytes() for row in near], pa.binary())
            for band, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), band), pa.int32()), pa.array((fps & mask).view(np.int64)), batch.column(0), tables], ["band", "key", "fp", "distances"])

    keyed = stored(distinct.select("fp").mapInArrow(keys, keyed_schema), "bands")
    crowds = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    parts = F.ceil(F.col("rows") / F.lit(cell))
    mine = F.pmod(F.xxhash64("fp"), parts)
    cells = (
        keyed.join(crowds, ["band", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "distances")
    )
    ordered = cells.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "fp")
    schema = "src bigint, dst bigint"
    arrow = to_arrow_schema(distinct.sparkSession.createDataFrame([], schema).schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells arrive one after the other; the last one of a batch may go on in the next."""

        def closed(place: np.ndarray, fps: np.ndarray, near: np.ndarray, last: bool):
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1), len(place)] if len(place) else [0]
            out = [_forest(fps[a:b], near[a:b], bits) for a, b in zip(edges, edges[1:] if last else edges[1:-1]) if b - a > 1]
            keep = len(place) if last else edges[-2] if len(edges) > 1 else 0
            columns = [np.concatenate([x[i] for x in out]).view(np.int64) if out else np.empty(0, np.int64) for i in (0, 1)]
            return keep, pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

        place, fps, near = np.empty((0, 4), np.int64), np.empty(0, np.uint64), np.empty((0, pivots), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            place = np.concatenate([place, np.column_stack([column(i).astype(np.int64) for i in range(4)])])
            fps = np.concatenate([fps, column(4).view(np.uint64)])
            near = np.concatenate([near, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, pivots)])
            keep, found = closed(place, fps, near, False)
            place, fps, near = place[keep:], fps[keep:], near[keep:]
            yield found
        yield closed(place, fps, near, True)[1]

    return ordered.mapInArrow(meet, schema)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most ``bits`` bits, itself included.

    One row per row. Texts without words have fingerprint zero and link like any other; rows without doc_id take part in
    links, but a component's id is the smallest non-null one (null if there is none). Other columns are ignored.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    components = _components(prints, F.col("doc_id"), bits)
    return prints.join(components, "fp", "left").select("doc_id", "fp", F.col("least").alias("component_id"))


def _components(prints: DataFrame, of: Column, bits: int) -> DataFrame:
    """fp and ``least``, the least ``of`` in the component of each distinct fingerprint."""
    distinct = stored(prints.groupBy("fp").agg(F.min(of).alias("own")), "distinct")
    roots = connected_components(fingerprint_links(distinct, bits))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("shared"))
    least = F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("shared")).alias("least")
    return stored(rooted.join(smallest, "root", "left").select("fp", "root", least), "components")


def drop_near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of each component only the one with the smallest doc_id; of rows
    that repeat this doc_id one stays. Rows without doc_id come last.

    The rows are numbered in a stored copy, so that the choice and the texts are read from the same numbering.
    """
    number = "__row"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    prints = stored(fingerprints(numbered.withColumn("doc_id", F.col(number)), words).withColumnRenamed("doc_id", "row"), "fingerprints")
    ids = numbered.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    known = prints.join(ids, "row").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    components = _components(known, F.col("rank"), bits)
    chosen = components.select(F.col("least.row").alias(number)).distinct()
    return numbered.join(chosen, number, "left_semi").select(*docs.columns)


def fingerprint_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
