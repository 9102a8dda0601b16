import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.operators import coldstart, entities, search
from slatewise.operators.coldstart import ColdStartWeights
from slatewise.plans.recommend import recommend
from slatewise.operators import graph


def _tokens(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def _brute(requests, catalog, w, out_of=()):
    out = {}
    for q, text, user, meta in requests:
        scored = []
        for pos, _, title in catalog:
            a, b = _tokens(text), _tokens(title)
            lexical = len(a & b) / len(a | b) if a and b else 0.0
            noise = int(hashlib.sha256(f"{user}:{title}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF if user else 0.0
            prior = 1.0 - pos / max(1, len(catalog) - 1)
            decay = math.exp(-math.log(2.0) / w.half_life * pos)
            scored.append((lexical * w.lexical + prior * w.prior + noise * w.noise + meta * w.meta + decay * w.decay, pos))
        out[q] = [p for _, p in sorted(scored, key=lambda s: (-s[0], s[1])) if (q, p) not in out_of][: w.top_k]
    return out


def test_cold_start_is_exact(spark):
    rng = random.Random(1)
    words = ["red", "blue", "old", "bolt", "ring", "gear", "saga", "night"]
    catalog = [(i, str(i), f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(40)}") for i in range(900)]
    requests = [(q, f"{rng.choice(words)} {rng.choice(words + ['none'])}", f"u{q}" if q % 3 else None, rng.random()) for q in range(25)] + [(99, "", "u", 0.1)]
    w = ColdStartWeights(top_k=15)
    asked = spark.createDataFrame(requests, "query_id long, query_text string, user_id string, meta_score double")
    items = spark.createDataFrame(catalog, "pos long, item_id string, title string")
    got = coldstart.cold_start_candidates(asked, items, w).orderBy("query_id", "rank").collect()
    want = _brute(requests, catalog, w)
    for q in want:
        assert [r.pos for r in got if r.query_id == q] == want[q]


def test_items_are_left_out_before_the_cut(spark):
    rng = random.Random(7)
    catalog = [(i, str(i), f"{rng.choice(['red', 'blue'])} {rng.choice(['bolt', 'ring'])} {i % 3}") for i in range(600)]
    requests = [(q, rng.choice(["red bolt", "blue", "none"]), f"u{q}" if q % 2 else None, 0.1) for q in range(6)]
    out_of = {(q, p) for q in range(5) for p in range(600) if rng.random() < (0.95 if q == 1 else 0.3) or p < 60} | {(4, p) for p in range(600)}
    asked = spark.createDataFrame(requests, "query_id long, query_text string, user_id string, meta_score double")
    items = spark.createDataFrame(catalog, "pos long, item_id string, title string")
    exclude = spark.createDataFrame(sorted(out_of) + [(0, 0)], "query_id long, pos long")
    for w in (ColdStartWeights(top_k=15), ColdStartWeights(top_k=15, prior=0.0)):
        got = coldstart.top_up(asked, items, exclude, 15, w).orderBy("query_id", "rank").collect()
        want = _brute(requests, catalog, w, out_of)
        assert not want[4] and all([r.pos for r in got if r.query_id == q] == want[q] for q in want)


def test_cold_start_hot_title_and_small_catalogue(spark):
    w = ColdStartWeights(top_k=4)
    catalog = [(i, str(i), "same title" if i % 2 else f"t {i}") for i in range(40)]
    requests = [(1, "same", None, 0.1), (2, "title same", "u", 0.2)]
    asked = spark.createDataFrame(requests, "query_id long, query_text string, user_id string, meta_score double")
    for rows in (catalog, catalog[:1], []):
        items = spark.createDataFrame(rows, "pos long, item_id string, title string")
        got = coldstart.cold_start_candidates(asked, items, w).orderBy("query_id", "rank").collect()
        want = _brute(requests, rows, w) if rows else {1: [], 2: []}
        for q in want:
            assert [r.pos for r in got if r.query_id == q] == want[q]


def _most_written(spark, run):
    """The largest number of rows that one operator of the run's queries made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = run()
    most, found = 0, store.executionsList()
    for i in range(found.size()):
        execution = found.apply(i)
        if execution.executionId() >= before:
            values = store.executionMetrics(execution.executionId())
            for j in range(execution.metrics().size()):
                metric = execution.metrics().apply(j)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return rows, most


@pytest.mark.parametrize("user", [None, "u"])
def test_cold_start_opens_only_what_can_count(spark, user):
    """Requests of many copies of few titles: rows grow with the requests, not with requests times positions."""
    items = spark.range(20000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("item_id"), F.concat(F.lit("red "), F.when(F.col("id") % 2 == 0, "bolt").otherwise("ring")).alias("title"))
    who = F.lit(None).cast("string") if user is None else F.concat(F.lit(user), F.col("id").cast("string"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.lit("red bolt").alias("query_text"), who.alias("user_id"), F.lit(0.1).alias("meta_score"))
    shown = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("pos"))
    got, most = _most_written(spark, lambda: coldstart.top_up(asked, items, shown, 10).orderBy("query_id", "rank").collect())
    assert [r.pos for r in got if r.query_id == 7] == [50 + 2 * i for i in range(10)]
    assert most < 300 * 200


def test_half_life_and_meta_prior(spark):
    row = spark.range(1).select(
        coldstart.X.popularity_decay(F.lit(50), 1000, 50.0).alias("d"), coldstart.X.popularity_decay(F.lit(5), 1, 50.0).alias("one"),
        coldstart.meta_prior(F.lit(1.0), F.lit(9.0), F.lit(0.5), F.lit(0.0), F.lit(0.0)).alias("m"),
    ).first()
    assert abs(row.d - 0.5) < 1e-12 and row.one == 1.0 and row.m == 1.0


def _greedy(records, threshold):
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s.lower().strip()))
    blocks, resolved = {}, {}
    for rid, name in records:
        parts = norm(name).split()
        blocks.setdefault(parts[0][:3] if parts else "unknown", []).append((rid, set(parts)))
    for block in blocks.values():
        for i, (a, x) in enumerate(block):
            if a in resolved:
                continue
            resolved[a] = a
            for b, y in block[i + 1 :]:
                if b not in resolved and (x == y or (len(x & y) / len(x | y) if x | y else 1.0) >= threshold):
                    resolved[b] = a
    return resolved


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_entity_resolution_is_greedy(spark, threshold):
    rng = random.Random(2)
    words = ["Acme", "acme", "corp", "inc", "north", "south", "ltd.", "Acorn", "co"]
    records = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(150)] + [(150 + i, "acme corp inc") for i in range(60)]
    df = spark.createDataFrame([(i, i, n) for i, n in records], "record_id long, pos long, name string")
    got = {r.record_id: r.canonical_id for r in entities.resolve_entities(df, threshold).collect()}
    assert got == _greedy(records, threshold)


def test_chain_is_not_closed(spark):
    rows = [(1, 1, "abc one two three four"), (2, 2, "abc one two three five"), (3, 3, "abc one two six five")]
    df = spark.createDataFrame(rows, "record_id long, pos long, name string")
    got = {r.record_id: r.canonical_id for r in entities.resolve_entities(df, 0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_longest_mention_folds_accents(spark):
    names = spark.createDataFrame([(0, "Ann"), (1, "José Ánn"), (2, "J. R. R. T")], "pos long, name string")
    texts = spark.createDataFrame([(1, "books by JOSE ANN please"), (2, "jrrt"), (3, "nothing here")], "text_id long, text string")
    got = {r.text_id: r.name for r in search.longest_mention(texts, names).collect()}
    assert got == {1: "José Ánn", 2: "J. R. R. T"}


def test_matcher_equals_letter_groups(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    needles = [word(rng.randrange(1, 6)) for _ in range(80)] + ["", None, "aa", "aaa", "a" * 40]
    texts = [word(rng.randrange(0, 60)) for _ in range(60)] + ["", None, "a" * 300, "a" * 300]
    named = spark.createDataFrame([(n, i) for i, n in enumerate(needles)], "needle string, body long")
    bodies = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "body_id long, body string, needle int")
    want = sorted({(n, i) for n in needles if n for i, t in enumerate(texts) if t and n in t})
    for letters in (search.MATCHER_LETTERS, 0):
        got = search.contained_pairs(named, bodies, letters)
        assert sorted((r.needle, r.body_id) for r in got.collect()) == want
        assert search.contained_pairs(named.limit(0), bodies, letters).count() == 0
        assert search.contained_pairs(named, bodies.limit(0), letters).count() == 0
    names = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "pos long, name string")
    asked = bodies.select(F.col("body_id").alias("text_id"), F.col("body").alias("text"))
    read = lambda letters: sorted(map(tuple, search.longest_mention(asked, names, letters=letters).collect()))
    assert read(search.MATCHER_LETTERS) == read(0)


def test_recommend_unknown_and_known(spark):
    titles = ["red storm", "red storm two", "blue night", "old night saga", "green field", "blue field", "red dawn", "dark dawn", "light dawn", "calm sea"]
    catalog = spark.createDataFrame([(i, str(i), t, f"{t} film", 1) for i, t in enumerate(titles)], "pos long, item_id string, title string, text string, attribute_count int")
    edges = graph.catalog_edges(catalog.withColumn("d", F.lit("one director")), {"d": "director"}, None)
    asked = spark.createDataFrame([("a", "Red Storm ", None, 0.1), ("b", "unseen dawn", None, 0.1)], "query_id string, query_title string, user_id string, meta_score double")
    got = recommend(asked, catalog, edges).toPandas()
    known, unknown = got[got.query_id == "a"], got[got.query_id == "b"]
    assert "red storm" not in set(known.title) and 5 <= len(known) <= 10
    assert known.sort_values("rank").title.iloc[0] == "red storm two"
    assert len(unknown) == 10 and set(unknown.channel) == {"cold_start_new_user"}


def test_word_sets_are_written_as_tables(spark):
    """Word sets and prefixes are compressed columns in the shared folder."""
    rows = [(i, i, f"alpha beta gamma w{i % 4} w{i % 3}") for i in range(24)]
    members, pairs = entities.match_pairs(spark.createDataFrame(rows, "record_id long, pos long, name string"), 0.5)
    assert pairs.inputFiles() and members.inputFiles()
    words = [set(name.split()) for _, _, name in rows]
    first = {frozenset(w): min(i for i, v in enumerate(words) if v == w) for w in words}
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.5}
    assert {(r.pos_i, r.pos_j) for r in pairs.collect()} == want


def test_folded_mention_sends_texts_to_python_once(spark):
    rows = [(1, "Die ﬁne Café.Bar № 5"), (2, "ÉCOLE I.İ"), (3, None), (4, ""), (5, "plain cafebar"), (6, "日本")]
    texts = spark.createDataFrame(rows, "text_id long, text string")
    names = spark.createDataFrame([(0, "cafe bar"), (1, "école"), (2, "no5"), (3, "i i"), (4, "日本")], "pos long, name string")
    found = search.longest_mention(texts, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "RLIKE(text" not in plan  # names alone go to the accent table
    by_groups = search.longest_mention(texts, names, letters=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_groups.collect()))
    assert {r.text_id: r.name for r in found.collect()} == {1: "cafe bar", 2: "école", 5: "cafe bar"}


def test_match_pairs_are_those_of_all_pairs_in_cells_of_any_size(spark, monkeypatch):
    """Crowded blocks in chunks, blocks that share a cell, copies, and sets of very unlike size; no pair is shuffled."""
    rng = np.random.default_rng(2)
    words = ["red", "bolt", "ring", "nut", "steel", "small", "brass", "long", "thin", "x1", "x2", "x3"]
    names = [" ".join([str(rng.choice(["abc", "abd", "zed"]))] + [str(w) for w in rng.choice(words, int(rng.integers(1, 9)))]) for _ in range(160)]
    names += names[:20] + ["", "  ", None, "abc " + " ".join(f"w{i}" for i in range(3000)), "abc " + " ".join(f"w{i}" for i in range(2500))]
    df = spark.createDataFrame(list(enumerate(names)), "pos long, name string").withColumn("record_id", F.concat(F.lit("r"), "pos"))
    sets, first = {}, {}
    for i, name in enumerate(names):
        parts = (name or "").split()
        first.setdefault((parts[0][:3] if parts else "unknown", frozenset(parts)), i)
    for block, words_of in first:
        sets.setdefault(block, []).append((first[block, words_of], words_of))
    for threshold in (0.5, 0.8, 1.0):
        want = {(b, min(i, j), max(i, j)): len(x & y) / len(x | y) for b, of in sets.items() for i, x in of for j, y in of if i < j and x and y and len(x & y) / len(x | y) >= threshold}
        for cell in (16_384, 7):
            monkeypatch.setattr(entities, "CELL_RECORDS", cell)
            members, pairs = entities.match_pairs(df, threshold)
            rows = pairs.collect()
            assert {(r.block, r.pos_i, r.pos_j): r.score for r in rows} == want and len(rows) == len(want)
            assert "SortMergeJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {r.record_id: r["first"] for r in members.collect()}["r165"] == 5
