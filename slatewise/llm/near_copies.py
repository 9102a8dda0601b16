"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as components.

Fingerprints of 64 bits and a radius that similarity 0.8 needs would leave nearly all pairs to be looked at. So a text has a
SimHash of 256 bits, and bands of min-hashes name the texts that meet at all. Among those that meet, distances to pivots and
then the fingerprints discard what is too far apart, which leaves clusters; inside a cluster the survivors are verified by
their whole shingle sets, nearest first, and pairs already joined are passed over. A cluster too large for one task is dealt
into chunks that share some anchors; what stays outside the cluster's main component is then held against all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from slatewise.llm.common import map_rows, stored, text_bytes
from slatewise.llm.components import connected_components

WORDS, SIMILARITY = 5, 0.8
#: Min-hash bands and rows of a band: texts of similarity 0.8 meet in none of them in 2 of 100,000 cases.
BANDS, BAND_ROWS = 36, 6
#: 64-bit words of a fingerprint, and the greatest distance of two that are compared: 4.4 standard deviations above what
#: similarity 0.8 gives.
LANES, RADIUS = 4, 64
#: Reference fingerprints.
PIVOTS = 16
#: Texts of one cell, and texts of a cluster that all its cells share.
CELL, ANCHORS = 256, 32
#: Shingles hashed at once.
AT_ONCE = 4096

_rng = np.random.default_rng(2025)
_FACTORS = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE_SEEDS = _rng.integers(0, 2**64, LANES, dtype=np.uint64)
_BAND_SEEDS = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)
_REFERENCES = _rng.integers(0, 2**64, (PIVOTS, LANES), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words are none."""
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint (LANES words) and a key for every band."""
    ones = np.zeros((LANES, 64), np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), AT_ONCE):
        part = hashes[start : start + AT_ONCE]
        for lane in range(LANES):
            bits = _mixed(part ^ _LANE_SEEDS[lane]).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[lane] += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (_mixed(part)[None, :] * _FACTORS[:, None]).min(axis=1))
    prints = np.packbits(2 * ones > len(hashes), axis=1).view(">u8").ravel().astype(np.uint64)
    keys = _BAND_SEEDS.copy()
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys ^ row)
    return prints, keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None, :] ^ _REFERENCES[None]).sum(axis=2, dtype=np.int16)


def near_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distance of the pairs within ``radius``. Two fingerprints differ by at most their distance in every
    pivot coordinate, so pairs with a larger difference in one are discarded before they are compared."""
    distances = pivot_distances(prints)
    order = np.argsort(distances[:, 0], kind="stable")
    first = distances[order, 0].astype(np.int64)
    behind = np.searchsorted(first, first + radius, side="right") - np.arange(len(prints)) - 1
    left = np.repeat(np.arange(len(prints)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    left, right = order[left], order[right]
    for pivot in range(1, PIVOTS):
        kept = np.abs(distances[left, pivot] - distances[right, pivot]) <= radius
        if not kept.all():
            left, right = left[kept], right[kept]
    apart = np.bitwise_count(prints[left] ^ prints[right]).sum(axis=1, dtype=np.int64)
    kept = apart <= radius
    return left[kept], right[kept], apart[kept]


class Forest:
    """Sets of numbers that are joined two by two."""

    def __init__(self, count: int) -> None:
        self.parent = list(range(count))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def verified(prints: np.ndarray, sets: list[np.ndarray], known: list[int], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (positions) between texts of a cell that join all texts of the required similarity, nearest fingerprints first.
    ``known``: what is joined already; equal numbers are not compared."""
    sizes = np.array([len(s) for s in sets])
    left, right, apart = near_pairs(prints)
    alike = np.minimum(sizes[left], sizes[right]) >= least * np.maximum(sizes[left], sizes[right])
    order = np.argsort(apart[alike], kind="stable")
    forest, first, out = Forest(len(sets)), {}, []
    for place, number in enumerate(known):
        forest.join(first.setdefault(number, place), place)
    for a, b in zip(left[alike][order].tolist(), right[alike][order].tolist()):
        if forest.root(a) != forest.root(b) and jaccard(sets[a], sets[b]) >= least:
            forest.join(a, b)
            out.append((a, b))
    return out


def each_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of equal first ``keys`` columns in a sorted stream, one after the other."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        places = np.column_stack([now.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield now.slice(a, b - a)
        rest = now.slice(edges[-1])
    if rest is not None:
        yield rest


def _grouped(df: DataFrame, keys: list[str], schema: str, links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """``links`` of every group of ``keys`` as rows (src, dst); groups are bounded, and a task holds one at a time."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in each_group(batches, len(keys)):
            if group.num_rows > 1:
                out += links(group.combine_chunks())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=arrow)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


LINKS = "src bigint, dst bigint"
SKETCHED = f"row bigint, same string, n int, {', '.join(f'f{i} bigint' for i in range(LANES))}, keys array<bigint>"
PRINT = [f"f{i}" for i in range(LANES)]


def sketches(docs: DataFrame) -> DataFrame:
    """row, ``same`` (a digest of the words: equal for texts that differ in white space and case of A-Z only), number of
    shingles, fingerprint and band keys of every row (row, text)."""

    def make():
        def run(rows, texts):
            out = []
            for row, data in zip(rows, texts):
                words = data.lower().split()
                hashes = shingle_set(words)
                prints, keys = sketch(hashes)
                out.append((row, blake2b(b" ".join(words), digest_size=16).hexdigest(), len(hashes), *prints.view(np.int64).tolist(), keys.view(np.int64).tolist()))
            return out

        return run

    return map_rows(docs.select("row", text_bytes()), SKETCHED, make)


def _prints_of(group: pa.Table) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([group.column(f).to_numpy() for f in PRINT])).view(np.uint64)


def _meeting(group: pa.Table) -> list[tuple[int, int]]:
    """A forest of the texts of one key that are within the radius."""
    nodes = group.column("row").to_pylist()
    left, right, _ = near_pairs(_prints_of(group))
    forest = Forest(len(nodes))
    return [(nodes[a], nodes[b]) for a, b in zip(left.tolist(), right.tolist()) if forest.join(a, b)]


def clusters(texts: DataFrame) -> DataFrame:
    """node, root: texts (row, keys, fingerprint) that may be joined have the same root; texts that meet none are left out.

    The texts of a key that more than CELL of them hold are taken as one cluster unseen: it only has to be large enough.
    """
    keyed = stored(texts.select("row", F.explode("keys").alias("key")), "keys")
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("row").alias("least")).filter("many > 1")
    met = stored(keyed.join(crowds, "key"), "met")
    starred = met.filter(F.col("many") > CELL).filter("row <> least").select(F.col("row").alias("src"), F.col("least").alias("dst"))
    small = met.filter(F.col("many") <= CELL).select("key", "row").join(texts.select("row", *PRINT), "row")
    return connected_components(starred.distinct().unionByName(_grouped(small.select("key", "row", *PRINT), ["key"], LINKS, _meeting)))


def _whole(group: pa.Table) -> list[tuple[int, int]]:
    nodes, known = group.column("row").to_pylist(), group.column("known").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    return [(nodes[a], nodes[b]) for a, b in verified(_prints_of(group), sets, known)]


def similar_links(texts: DataFrame, shingles: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (src, dst) that join distinct texts into components of similarity 0.8 or more.

    ``texts``: row, keys, fingerprint; ``shingles`` adds the sets to rows. A cluster of up to CELL texts is one cell. A larger
    one is dealt into cells that all hold the same ANCHORS of its texts; after that, texts outside its largest component meet
    all its texts, cell by cell. So nothing is compared in pairs but what the components leave apart.
    """
    grouped = clusters(texts)
    sized = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = texts.select("row", *PRINT).join(grouped.withColumnRenamed("node", "row"), "row").join(sized, "root")
    members = stored(shingles(members).withColumn("place", F.xxhash64("row")), "members")
    cells = F.ceil(F.col("size") / CELL).cast("int")
    columns = ["root", "cell", "row", "known", *PRINT, "shingles"]
    # Anchors: about ANCHORS texts of a cluster by hash, in every one of its cells.
    anchor = (F.col("size") > CELL) & (F.pmod("place", F.ceil(F.col("size") / ANCHORS)) == 0)
    own = F.pmod(F.shiftright("place", 20), cells)
    dealt = members.withColumn("known", F.col("row")).withColumn("cell", F.explode(F.when(anchor, F.sequence(F.lit(0).cast("long"), cells.cast("long") - 1)).otherwise(F.array(own.cast("long")))))
    first = stored(_grouped(dealt.select(*columns), ["root", "cell"], LINKS, _whole), "links")
    large = members.filter(F.col("size") > CELL)
    if not large.limit(1).count():
        return first
    joined = connected_components(first).select(F.col("node").alias("row"), F.col("root").alias("component"))
    apart = large.join(joined, "row", "left").withColumn("known", F.coalesce("component", "row")).drop("component")
    counts = apart.groupBy("root", "known").agg(F.count(F.lit(1)).alias("many"))
    main = counts.groupBy("root").agg(F.max_by("known", F.struct("many", "known")).alias("main"), F.max("many").alias("most"))
    apart = stored(apart.join(main, "root").filter(F.col("size") > F.col("most")), "apart")
    minor, whole = F.ceil((F.col("size") - F.col("most")) / CELL), F.ceil(F.col("size") / CELL)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    at = F.shiftright("place", 20)
    outside = apart.filter("known <> main").withColumn("a", F.pmod(at, minor)).withColumn("b", F.explode(every(whole)))
    inside = apart.withColumn("b", F.pmod(F.shiftright("place", 10), whole)).withColumn("a", F.explode(every(minor)))
    told = lambda df: df.select("root", "a", "b", "row", "known", *PRINT, "shingles")
    both = told(outside).unionByName(told(inside)).dropDuplicates(["root", "a", "b", "row"])
    return first.unionByName(_grouped(both, ["root", "a", "b"], LINKS, _whole))


def near_copies(docs: DataFrame, least: Column) -> DataFrame:
    """row, same and ``first``: the least value of ``least`` (over the columns of ``docs``) in the component of each row of ``docs`` (row, text, ...)."""
    drawn = stored(sketches(docs), "sketches")
    known = drawn.select("row", "same").join(docs.select("row", least.alias("value")), "row")
    heads = stored(known.groupBy("same").agg(F.min("row").alias("head"), F.min("value").alias("value")), "heads")
    texts = drawn.join(heads.select(F.col("head").alias("row")), "row", "left_semi")

    def shingles(members: DataFrame) -> DataFrame:
        def make():
            return lambda rows, data: [(r, shingle_set(d.lower().split()).tobytes()) for r, d in zip(rows, data)]

        chosen = docs.select("row", "text").join(members.select("row"), "row", "left_semi")
        return members.join(map_rows(chosen.select("row", text_bytes()), "row bigint, shingles binary", make), "row")

    links = similar_links(texts.filter("n > 0"), shingles)
    roots = stored(connected_components(links).withColumnRenamed("node", "head"), "roots")
    placed = heads.join(roots, "head", "left").withColumn("root", F.coalesce("root", "head"))
    firsts = placed.groupBy("root").agg(F.min("value").alias("first"))
    by_text = placed.join(firsts, "root").select("same", "first")
    return known.select("row", "same").join(by_text, "same")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of each component of texts with a five-word Jaccard similarity of
    0.8 or more only the one with the smallest doc_id (of rows that repeat it, one; rows without doc_id come last).

    Texts that differ only in white space or in the case of A-Z are the same text; null, empty and blank texts are one text.
    A text of fewer than five words is one shingle. An empty table stays empty. Rows are numbered in a stored copy, so that
    the choice and the texts are read from the same numbering.
    """
    number = "__row"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(number).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = near_copies(rows, rank).select(F.col("first.row").alias(number)).distinct()
    return numbered.join(chosen, number, "left_semi").select(*docs.columns)
