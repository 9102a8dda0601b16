"""The skew-safe paths give the same rows as the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.operators import graph, losses, policy, text_similarity, vectors
from slatewise.operators.scale import _running_over_ranges, numbered, ranges_of, running_sums, top_n_per_group


def _rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def _skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randrange(7), rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, pos long, v long, x long")


def test_running_sums_hot_groups(spark):
    df = _skewed(spark)
    plain = running_sums(df, ["k"], ["v", "pos"], {"s": "x"}, hot_rows=None)
    cut = running_sums(df, ["k"], ["v", "pos"], {"s": "x"}, hot_rows=100)
    assert _rows(plain.fillna("-"), "k", "pos", "s") == _rows(cut.fillna("-"), "k", "pos", "s")


def test_running_minimum_hot_groups(spark):
    df = _skewed(spark).withColumn("x", F.when(F.col("x") < 40, F.col("x")))
    plain = running_sums(df, ["k"], ["v", "pos"], {"s": "x"}, hot_rows=None, least=True)
    cut = running_sums(df, ["k"], ["v", "pos"], {"s": "x"}, hot_rows=100, least=True)
    read = lambda d: sorted((r.pos, r.s) for r in d.fillna({"s": -1}).collect())
    assert read(plain) == read(cut)


def test_running_sums_of_awkward_rows(spark):
    schema = "a string, b long, at double, x double"
    rows = [("k", None, float(i), None if i % 3 else float(i)) for i in range(40)] + [(None, 1, -float(i), 1.0) for i in range(40)] + [("k", 2, 0.5, None)]
    df = spark.createDataFrame(rows, schema)
    read = lambda d: sorted((str(r.a), str(r.b), r["at"], str(r.s), str(r.t)) for r in d.collect())
    for least in (False, True):
        plain = running_sums(df, ["a", "b"], ["at"], {"s": "x", "t": "at"}, None, least)
        assert read(running_sums(df, ["a", "b"], ["at"], {"s": "x", "t": "at"}, 5, least)) == read(plain)
    nothing = running_sums(df.limit(0), ["a"], ["at"], {"s": "x"}, 5)
    assert nothing.columns == ["a", "b", "at", "x", "s"] and nothing.count() == 0
    words = df.select(F.col("at").cast("string").alias("w"), F.lit(1).alias("one")).distinct()
    assert sorted(r.n for r in running_sums(words, [], ["w"], {"n": "one"}, 5).collect()) == list(range(1, words.count() + 1))


def test_ranges_grow_with_rows(spark):
    assert [ranges_of(n, 1000) for n in (1001, 10_000, 1_000_000)] == [3, 20, 2000]
    for rows in (1000, 4000):
        laid = _running_over_ranges(spark.range(rows).withColumn("__all", F.lit(0)), ["__all"], ["id"], {"s": "id"}, F.sum, ranges_of(rows, 200))
        assert max(r["count"] for r in laid.groupBy("__range").count().collect()) <= 200


def test_ranges_do_not_multiply_with_the_rows(spark):
    """A low limit on groups lays small tables out in small ranges, and large tables in larger ranges, not in more and more tasks."""
    df = spark.range(60_000).withColumn("k", F.col("id") % 3)
    cut = running_sums(df, ["k"], ["id"], {"s": "id"}, hot_rows=100)
    assert 200 <= len(cut.inputFiles()) <= 256
    assert cut.exceptAll(running_sums(df, ["k"], ["id"], {"s": "id"}, hot_rows=None)).count() == 0


def test_global_numbers_are_dense(spark):
    df = numbered(_skewed(spark), [], ["v", "pos"], "n", hot_rows=200)
    assert sorted(r.n for r in df.collect()) == list(range(1, 3001))
    assert [r.pos for r in df.orderBy("n").collect()] == [r.pos for r in df.orderBy("v", "pos").collect()]


def test_large_top_n_uses_salts(spark):
    df = _skewed(spark)
    got = top_n_per_group(df, ["k"], [F.col("x").desc(), F.col("pos")], 1200)
    want = df.toPandas().fillna({"k": "-"}).sort_values(["x", "pos"], ascending=[False, True]).groupby("k").head(1200)
    assert sorted(r.pos for r in got.collect()) == sorted(want["pos"])


def test_hinge_equals_all_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), i, rng.randrange(2), rng.choice([0.0, 0.5, 1.0, 1.5, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(data, "query_id string, pos long, label int, score double")
    for hot_rows in (None, 20):
        got = {r.query_id: (r.pairs, r.loss) for r in losses.pairwise_hinge(df, 0.5, hot_rows).collect()}
        for q in ("a", "b", None):
            terms = [max(0.0, 0.5 - p[3] + n[3]) for p in data for n in data if p[0] == n[0] == q and p[2] > 0 >= n[2]]
            assert got[q][0] == len(terms)
            assert abs(got[q][1] - sum(terms) / len(terms)) < 1e-9


def test_lambdarank_blocks(spark):
    rng = random.Random(4)
    data = [("q", i, rng.randrange(3), rng.random()) for i in range(60)]
    df = spark.createDataFrame(data, "query_id string, pos long, label int, score double")
    values = {b: losses.lambdarank(df, block=b).collect()[0] for b in (7, 512)}
    assert values[7].pairs == values[512].pairs and abs(values[7].loss - values[512].loss) < 1e-12
    order = sorted(data, key=lambda r: (-r[3], r[1]))
    place = {r[1]: i for i, r in enumerate(order)}
    gain = lambda r, i: (2 ** r[2] - 1) / np.log2(i + 2)
    ideal = sum(gain(r, i) for i, r in enumerate(sorted(data, key=lambda r: -r[2])))
    terms = [abs(gain(a, place[a[1]]) - gain(b, place[b[1]])) / ideal * np.log1p(np.exp(b[3] - a[3])) for a in data for b in data if a[2] > b[2]]
    assert abs(values[7].loss - np.mean(terms)) < 1e-9


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    for hot_rows in (None, 3):
        data = [(rng.randrange(2), rng.choice([0.1, 0.2, 0.2, 0.7, rng.random()])) for _ in range(150)]
        got = losses.auc(spark.createDataFrame(data, "label int, score double"), hot_rows=hot_rows).first()["auc"]
        p, n = [s for y, s in data if y], [s for y, s in data if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
        assert abs(got - want) < 1e-12


def test_diversity_against_greedy(spark):
    rng = random.Random(6)
    slates = [(f"q{q}", i, rng.choice("abc"), rng.choice([0.9, 0.8, 0.5, rng.random()]), i + 1) for q in range(40) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(slates, "query_id string, pos long, group_key string, score double, rank long")
    for hot_rows in (None, 5):
        got = policy.diversity_rerank(df, hot_rows=hot_rows).orderBy("query_id", "new_rank").collect()
        for q in {r[0] for r in slates}:
            left, seen, want = [r for r in slates if r[0] == q], {}, []
            while left:
                free = [(0.75 * r[3] - 0.25 * seen.get(r[2], 0), r) for r in left if seen.get(r[2], 0) < 2]
                best = left[0]
                if free:
                    top = max(s for s, _ in free)
                    best = next(r for s, r in free if s == top)
                left.remove(best)
                seen[best[2]] = seen.get(best[2], 0) + 1
                want.append(best[1])
            assert [r.pos for r in got if r.query_id == q] == want


def test_vector_search_blocks_and_edges(spark):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(size=5).tolist(), "ab"[i % 2]) for i in range(80)] + [(80, [0.0] * 5, "a"), (81, [1.0] * 5, "b"), (82, [1.0] * 5, "b")]
    items = spark.createDataFrame(data, "pos long, vector array<double>, domain string")
    asked = spark.createDataFrame([(i, d[1], d[2] if i % 3 else None) for i, d in enumerate(data)], "query_id long, embedding array<double>, domain string")
    shipped = vectors.exact_search(items, asked, 6)
    blocked = vectors.exact_search(items, asked, 6, per_cell=7)
    columns = ("query_id", "pos", "rank", "score")
    assert _rows(shipped, *columns) == _rows(blocked, *columns)
    assert shipped.filter("query_id = 80").count() == 0
    unit = {p: np.array(v) / (np.linalg.norm(v) or 1.0) for p, v, _ in data}
    got = [r.pos for r in shipped.filter("query_id = 1").orderBy("rank").collect()]
    want = sorted((p for p, _, d in data if d == "b"), key=lambda p: (-round(float(unit[1] @ unit[p]), 12), p))[:6]
    assert got == want


def _plain_text_search(texts, asked, k):
    """(query, pos, score) of the best k by cosine of word counts, over every text; ``asked``: id, text, position or group left out."""
    import re
    from collections import Counter

    bag = lambda t: Counter(re.findall(r"\w{2,}", t.lower()))
    size = lambda c: sum(n * n for n in c.values()) ** 0.5 or 1.0
    bags = {t: bag(t) for _, t, _ in texts}
    out = []
    for query, text, position, group in asked:
        mine = bag(text)
        scored = [(-round(sum(n * bags[t][w] for w, n in mine.items()) / (size(mine) * size(bags[t])), 12), p) for p, t, g in texts if p != position and (group is None or g != group)]
        out += [(query, p, round(-s, 9), r) for r, (s, p) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("batch, part_rows", [(4096, 1), (0, 5), (0, 65536)])
def test_text_search_against_all_pairs(spark, batch, part_rows):
    """Frequent and rare words, equal texts in any word order, empty texts, fewer texts with a common word than wanted."""
    rng = random.Random(8)
    pool = ["red", "blue", "the", "the", "the", "of", "bolt", "nut", "x", *[f"rare{i}" for i in range(40)]]
    texts = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))), f"g{i % 5}") for i in range(150)]
    texts += [(200 + i, "the of the red", "g1") for i in range(40)] + [(300 + i, "red the the of", "hot") for i in range(40)]
    items = spark.createDataFrame(texts, "pos long, text string, item_group string").repartition(3)
    plain = [(i, t, None, None) for i, t, _ in texts] + [(900, "nothing known", None, None), (901, "", None, None), (902, "rare1 rare2", None, None)]
    asked = spark.createDataFrame([(i, t) for i, t, _, _ in plain], "query_id long, text string")
    got = text_similarity.text_top_k(items.drop("item_group"), asked, 6, broadcast_queries=batch, part_rows=part_rows)
    assert _rows(got, "query_id", "pos", "score", "rank") == _plain_text_search(texts, plain, 6)
    found = text_similarity.similar_titles(items.select("pos", "text"), 4)
    assert _rows(found, "query_id", "pos", "score", "rank") == _plain_text_search(texts, [(i, t, i, None) for i, t, _ in texts], 4)
    grouped = [(i, t, None, g) for i, t, g in texts[::3]] + [(999, "the of", None, "hot"), (998, "zz", None, "g0")]
    own = spark.createDataFrame([(i, t, g) for i, t, _, g in grouped], "query_id long, text string, own_group string")
    left_out = text_similarity.text_top_k(items, own, 5, broadcast_queries=batch, part_rows=part_rows)
    assert _rows(left_out, "query_id", "pos", "score", "rank") == _plain_text_search(texts, grouped, 5)


def test_structural_search_hot_neighbours(spark):
    rng = random.Random(9)
    rows = [(i, f"t{i % 30}", rng.choice(["d1", "d1", "d2", f"d{i}"]), rng.choice(["g1", "g1 g2", "g3"])) for i in range(120)]
    catalog = spark.createDataFrame(rows, "pos long, title string, director string, genres string")
    edges = graph.catalog_edges(catalog, {"director": "director"}, "genres")
    asked = catalog.select(F.col("title").alias("query_id"), F.lit("movie_title").alias("type"), F.col("title").alias("id")).distinct()
    plain = graph.structural_search(edges, asked, 8)
    folded = graph.structural_search(edges, asked, 8, hot_degree=10)
    assert _rows(plain, "query_id", "pos", "rank", "score") == _rows(folded, "query_id", "pos", "rank", "score")


def test_random_walk_follows_edges(spark):
    catalog = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "c", "y")], "pos long, title string, director string")
    edges = graph.catalog_edges(catalog, {"director": "director"}, None)
    starts = spark.createDataFrame([(i, "movie\u001f0") for i in range(200)] + [(999, "movie\u001fnone")], "walk_id long, node string")
    walk = graph.random_walk(edges, starts, 2).toPandas()
    pairs = {(r.node, r.neighbour) for r in graph.neighbours(edges).collect()}
    paths = walk.sort_values(["walk_id", "step"]).groupby("walk_id")["node"].apply(list)
    assert all((a, b) in pairs for p in paths for a, b in zip(p, p[1:]))
    assert paths[999] == ["movie\u001fnone"] and len(paths[0]) == 3
    first = walk[(walk.step == 1) & (walk.walk_id < 999)]["node"].value_counts()
    assert len(first) == 2 and first.min() > 60


def test_text_search_in_blocks(spark, monkeypatch):
    """Many blocks of queries and many parts of the texts; no pair of a query and a text is joined by a word."""
    monkeypatch.setattr(text_similarity, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(text_similarity, "PART_LETTERS", 90)
    monkeypatch.setattr(text_similarity, "TEXTS_AT_ONCE", 2)
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice(["red", "the", "the", "nut", f"rare{i % 9}"]) for _ in range(rng.randrange(0, 7))), f"g{i % 4}") for i in range(60)]
    items = spark.createDataFrame(texts, "pos long, text string, item_group string")
    asked = items.select(F.col("pos").alias("query_id"), "text", F.col("item_group").alias("own_group"))
    got = text_similarity.text_top_k(items, asked, 5, broadcast_queries=0)
    assert _rows(got, "query_id", "pos", "score", "rank") == _plain_text_search(texts, [(i, t, None, g) for i, t, g in texts], 5)
    assert "token" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_text_search_sorts_no_answers_of_copies(spark):
    """The answers of equal queries are opened from one list: no window over all of them."""
    items = spark.createDataFrame([(i, f"red nut {i % 3}") for i in range(30)], "pos long, text string")
    found = text_similarity.similar_titles(items, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and plan.index("Generate posexplode") < plan.index("Window")
    assert plan.index("Join") < plan.index("Window")
    assert _rows(found, "query_id", "pos", "score", "rank") == _plain_text_search([(r.pos, r.text, None) for r in items.collect()], [(r.pos, r.text, r.pos, None) for r in items.collect()], 4)
