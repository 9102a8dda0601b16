import hashlib
from collections import defaultdict

import numpy as np
import pytest

from slatewise.llm.vector_codes import block_codes, block_sums, compress, compressed, grow

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, code string, error int"


def plain(rows, parts=8, size=16, rounds=6):
    """Codes, errors and codebooks by looking at every entry for every part, in Python integers."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(kept[0][1]) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), la) for i, v, la in kept if len(v) == len(kept[0][1])]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:size]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((apart(part, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            given = defaultdict(list)
            for _, v, _ in kept:
                given[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(given[n]) for c in zip(*given[n])] if n in given else e for n, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, la in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), la))
        by_label[la] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, d, by_label[la], sha) for i, code, d, la in out), key=repr)


@pytest.mark.parametrize("leaf", [1, 4, 32])
@pytest.mark.parametrize("spread", [0, 1, 3, 1000])
def test_dual_trees_equal_all_pairs(leaf, spread):
    """Also with many ties and repeated entries (small spreads)."""
    rng = np.random.default_rng(leaf + spread)
    parts, size, width, many = 3, 7, 4, 300
    points = np.concatenate([rng.integers(-spread, spread + 1, (many, width)) + rng.integers(-5, 6, (many, 1)) * 10 * spread for _ in range(parts)])
    books = points.reshape(parts, many, width)[:, rng.integers(0, many, size)]
    trees = grow(points, [(p * many, (p + 1) * many) for p in range(parts)], leaf)
    apart = ((points.reshape(parts, many, 1, width) - books[:, None]) ** 2).sum(axis=3)
    codes, errors = block_codes(points, trees, books)
    assert (codes == apart.argmin(axis=2).T).all() and (errors == apart.min(axis=2).sum(axis=0)).all()
    counts, sums = block_sums(points, trees, books)
    for p in range(parts):
        for e in range(size):
            mine = apart[p].argmin(axis=1) == e
            assert counts[p, e] == mine.sum() and (sums[p, e] == points[p * many : (p + 1) * many][mine].sum(axis=0)).all()


def test_clustered_nodes_are_assigned_whole():
    from slatewise.llm.vector_codes import entry_trees, nearest

    rng = np.random.default_rng(3)
    centres = rng.integers(-(10**6), 10**6, (8, 8))
    points = (centres[:, None] + rng.integers(-50, 51, (8, 500, 8))).reshape(-1, 8)
    trees = grow(points, [(0, len(points))], 16)
    entries, codebook = entry_trees(centres[None])
    nodes, _, single, _ = nearest(points, trees, entries, codebook)
    assert (trees.ends[nodes] - trees.starts[nodes]).sum() + len(single) == len(points)
    assert len(single) < len(points) / 10 and len(nodes) < len(points) / 10


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16)], int(i) % 3 if i % 5 else None) for i in rng.permutation(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * 15 + [nan], 1), (902, [inf] + [0.0] * 15, 1), (903, [None] + [0.0] * 15, 2), (904, [1.0] * 8, 2), (905, [], 2), (-1, None, 0)]
    rows += [(3, rows[0][1], 1), (None, [0.25] * 16, None), (906, [0.0] * 16, 1)] + [(7, rows[5][1], 0)] * 30
    make = lambda some: spark.createDataFrame([(*r, "x", "y", 0) for r in some], SCHEMA).repartition(5)
    got = sorted(map(tuple, compressed(make(rows)).collect()), key=repr)
    assert got == plain(rows)
    few = rows[:5]
    assert sorted(map(tuple, compressed(make(few)).collect()), key=repr) == plain(few)
    odd = [(i, [float(i), 0.5, -0.5 * i], 1) for i in range(40)]
    assert sorted(map(tuple, compressed(make(odd)).collect()), key=repr) == plain(odd)
    huge = [(1, [1e30] * 16, 1), *few]
    assert sorted(map(tuple, compressed(make(huge)).collect()), key=repr) == plain(few)
    assert compressed(make(rows[200:201])).count() == 0 and compressed(make([])).count() == 0
    empty = [(i, [], 1) for i in range(3)]
    assert [(r["code"], r["error"], r["label_error"]) for r in compressed(make(empty)).collect()] == [("00" * 8, 0, 0)] * 3


def test_other_shapes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    codes = compress(table, parts=2, size=4, rounds=3)
    got = sorted((r["vec_id"], "".join(f"{c:02x}" for c in r["code"]), r["error"]) for r in codes.rows.collect())
    assert got == [r[:3] for r in sorted(plain(rows, 2, 4, 3))] and codes.codebooks.shape == (2, 4, 3)
