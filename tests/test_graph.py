"""Walks and embeddings against plain versions."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from slatewise.operators import graph

SEP = "\u001f"
EDGE = "src_type string, src string, dst_type string, dst string, relation string, weight double"


def _edges(spark, pairs):
    return spark.createDataFrame([("a", x, "b", y, "r", 1.0) for x, y in pairs], EDGE)


def _adjacency(pairs):
    table = collections.defaultdict(collections.Counter)
    for x, y in pairs:
        table[f"a{SEP}{x}"][f"b{SEP}{y}"] += 1
        table[f"b{SEP}{y}"][f"a{SEP}{x}"] += 1
    return table


def _walked(table, walk, node, steps):
    path = [node]
    for step in range(1, steps + 1):
        line = [n for n, times in sorted(table[path[-1]].items()) for _ in range(times)]
        if not line:
            break
        path.append(line[int(hashlib.md5(f"3_{step}_{walk}".encode()).hexdigest()[:15], 16) % len(line)])
    return path


def test_walks_follow_their_draws(spark):
    pairs = [("hub", str(i)) for i in range(60)] + [("hub", "7")] * 500 + [("x", "7"), ("x", "8"), ("x", "8")]
    table, edges = _adjacency(pairs), _edges(spark, pairs)
    starts = [(i, f"a{SEP}hub") for i in range(150)] + [(i, f"b{SEP}8") for i in range(150, 200)] + [(200, f"a{SEP}gone"), (201, None)]
    begun = spark.createDataFrame(starts, "walk_id long, node string")
    for hot_rows in (1_000_000, 10):
        rows = graph.random_walk(edges, begun, 4, hot_rows=hot_rows).orderBy("walk_id", "step").collect()
        got = collections.defaultdict(list)
        for r in rows:
            got[r.walk_id].append(r.node)
        assert dict(got) == {w: _walked(table, w, n, 4) for w, n in starts}


def test_parts_of_a_hub_stay_small(spark):
    pairs = [("hub", str(i)) for i in range(2000)] + [("hub", "7")] * 30_000
    parts = graph._drawable_edges(_edges(spark, pairs), 1_000_000).filter(F.col("node") == f"a{SEP}hub")
    assert parts.count() <= 2 * 2000 + 200
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= graph.EDGES_A_PART * (32_000 // 2000 + 1)


def test_embeddings_of_two_layers(spark):
    rng = np.random.default_rng(5)
    pairs = [(str(rng.integers(6)), str(rng.integers(9))) for _ in range(40)]
    table, edges = _adjacency(pairs), _edges(spark, pairs)
    nodes = sorted(table) + [f"a{SEP}99"]
    bare = sorted(table)[0]
    own = {n: rng.normal(size=3) for n in nodes if n != bare}
    layers = [graph.GraphLayer(rng.normal(size=(4, 6)).tolist(), rng.normal(size=4).tolist()), graph.GraphLayer(rng.normal(size=(2, 8)).tolist())]
    features = spark.createDataFrame([(n, v.tolist(), 1) for n, v in own.items()] + [(bare, None, 1)], "node string, vector array<double>, times int")
    current = dict(own)
    for number, layer in enumerate(layers):
        bias, following = np.array(layer.bias or [0.0, 0.0]), {}
        for n, vector in current.items():
            near = [(current[m], t) for m, t in table[n].items() if m in current]
            mean = sum(v * t for v, t in near) / sum(t for _, t in near) if near else np.zeros(len(vector))
            out = np.array(layer.weights) @ np.concatenate([vector, mean]) + bias
            following[n] = np.maximum(out, 0.0) if number == 0 else out / (np.linalg.norm(out) or 1.0)
        current = following
    embedded = graph.graph_embeddings(edges, features, layers)
    got = {r.node: r.vector for r in embedded.collect()}
    assert set(got) == set(current) and all(np.allclose(got[n], current[n]) for n in got)

    asked = spark.createDataFrame([(1, "b", "0"), (2, "a", "1"), (3, "a", "gone")], "query_id long, type string, id string")
    found = graph.embedding_search(embedded, asked, 3, "a").collect()
    for query, node in ((1, f"b{SEP}0"), (2, f"a{SEP}1")):
        if node in current:
            scores = {int(m[2:]): float(current[node] @ current[m]) for m in current if m.startswith("a") and m != node and m[2:].isdigit()}
            best = sorted(scores, key=lambda m: (-round(scores[m], 12), m))[:3]
            assert [r.pos for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query] == best
    assert not [r for r in found if r.query_id == 3]
    assert graph.graph_embeddings(edges.limit(0), features, layers).count() == len(own)
    assert graph.graph_embeddings(edges, features.limit(0), layers).count() == 0
