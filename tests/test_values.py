"""Hand-computed values of single operators."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators import (
    bandits, blending, contracts, embedding_quality, eventlog, experiments, explain, fairness, features, labels, losses, metrics, offpolicy, policy,
    quality, ranking, screening, training, vectors,
)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_off_policy_values(spark):
    rows = [("e", 1.0, 0.5, 0.4, None), ("e", 0.0, 0.5, 0.6, None), ("e", 1.0, 0.5, 0.5, None), ("e", 0.0, 0.8, 0.2, None), ("e", 1.0, 0.0, 0.5, None), ("z", 1.0, 0.0, 0.1, None)]
    df = spark.createDataFrame(rows, "x string, reward double, logging_propensity double, target_propensity double, direct_estimate double")
    ips = {r.x: r for r in offpolicy.ips(df, ["x"]).collect()}
    assert abs(ips["e"].value - 0.45) < 1e-12 and ips["e"].n == 4
    assert ips["z"].value == 0.0 and ips["z"].n == 0 and ips["z"].variance == 0.0 and ips["z"].lower == 0.0
    snips = offpolicy.snips(df, ["x"]).filter("x = 'e'").first()
    assert abs(snips.value - 1.8 / 3.25) < 1e-12
    weighted, m = [0.8, 0.0, 1.0, 0.0], 1.8 / 3.25
    assert abs(snips.variance - sum((w - m) ** 2 for w in weighted) / 3) < 1e-12
    names = [r.name for r in offpolicy.sensitivity(df, ["x"]).filter("x = 'e'").collect()]
    assert names[0] == "ips_perturbed_0.80" and len(names) == 5
    dr = offpolicy.doubly_robust(df, ["x"]).filter("x = 'e'").first()
    assert abs(dr.value - 0.45) < 1e-12


def test_guardrail_reasons(spark):
    df = spark.createDataFrame([(0.001, 0.0), (0.5, -0.1), (0.5, 0.1)], "value double, lower double")
    got = [(r.passed, r.reason) for r in offpolicy.causal_guardrail(df).collect()]
    assert got[0] == (False, "ATE 0.0010 is below minimum threshold 0.0100.")
    assert got[1][1].startswith("Lower confidence bound -0.1000") and got[2] == (True, "Experiment passed causal guardrails.")


def test_gini_and_tail(spark):
    provider = lambda counts: spark.createDataFrame([(f"p{i}",) for i, n in enumerate(counts) for _ in range(n)], "provider string")
    assert abs(fairness.provider_concentration(provider([4, 1, 1])).first().gini - 1 / 3) < 1e-12
    assert fairness.provider_concentration(provider([10, 10, 10])).first().gini == 0.0
    assert fairness.provider_concentration(provider([5])).first().gini == 0.0
    popularity = spark.createDataFrame([(str(i), float(i)) for i in range(10)], "item_id string, popularity double")
    shown = spark.createDataFrame([("0",), ("0",), ("9",)], "item_id string")
    row = fairness.long_tail_coverage(shown, popularity).first()
    assert (row.tail_items, row.recommended_tail_items) == (3, 1) and abs(row.long_tail_ratio - 1 / 3) < 1e-12


def test_delay_weights(spark):
    histogram = spark.createDataFrame([(24.0, 20), (1.0, 80)], "max_hours double, n long")
    distribution = labels.delay_distribution(histogram)
    rows = spark.createDataFrame([(1, 1, 5.0), (2, 0, None), (3, 0, 1.0), (4, 0, 99.0)], "id int, label int, delay_hours double")
    weight = lambda s: {r.id: r.weight for r in labels.adjust_labels(rows, distribution, s).collect()}
    assert weight("cdf") == {1: 1.0, 2: 0.05, 3: pytest.approx(0.8), 4: 1.0}
    assert weight("survival_weighted")[3] == pytest.approx(1 - 0.2**1.5)
    assert weight("defer")[3] == pytest.approx(0.64)
    many = labels.delay_distribution(spark.range(30_000).selectExpr("cast(id + 1 as double) AS max_hours", "1L AS n"), hot_rows=1000)
    got = {r.id: r.weight for r in labels.adjust_labels(rows, many, "cdf", labels.DelayWeights(floor=0.0), hot_rows=1000).collect()}
    assert got[3] == pytest.approx(1 / 30_000) and got[4] == pytest.approx(99 / 30_000)
    assert weight(" Defuse ")[3] == pytest.approx(0.6 * 0.64 + 0.4 * (1 - 0.2**1.5))
    with pytest.raises(ValueError):
        labels.adjust_labels(rows, distribution, "other")


def test_ranking_metrics(spark):
    listed = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "c"), ("r", 0, "a"), ("r", 1, "a")], "query_id string, position int, item_id string")
    truth = spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "a"), ("s", "a")], "query_id string, item_id string")
    asked = spark.createDataFrame([("q",), ("r",), ("s",), ("t",)], "query_id string")
    got = {r.query_id: r for r in metrics.ranking_metrics(listed, truth, asked, 3).collect()}
    assert got["q"].ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3))) and got["q"].recall == 1.0 and got["q"].mrr == 1.0
    assert got["q"].map == pytest.approx((1 + 2 / 3) / 2)
    assert got["r"].recall == 1.0 and got["s"].ndcg == 0.0 and got["t"].map == 0.0


def test_calibration(spark):
    df = spark.createDataFrame([(0.95, 1), (0.95, 0), (1.5, 1), (0.05, 0)], "prediction double, label int")
    row = metrics.calibration(df).first()
    mean = (0.95 + 0.95 + 1.0) / 3
    assert row.ece == pytest.approx((3 * abs(mean - 2 / 3) + 0.05) / 4)
    assert row.brier == pytest.approx((0.05**2 + 0.95**2 + 0.5**2 + 0.05**2) / 4)


def test_losses(spark):
    df = spark.createDataFrame([("q", 0, 1, 2.0), ("q", 1, 0, 1.0), ("one", 0, 1, 0.3)], "query_id string, pos long, label int, score double")
    e = math.exp
    soft = {r.query_id: r.loss for r in losses.listwise_softmax(df).collect()}
    assert soft["q"] == pytest.approx(-math.log(e(2) / (e(2) + e(1))) / 2) and soft["one"] == pytest.approx(0.0)
    mle = {r.query_id: r.loss for r in losses.listmle(df).collect()}
    assert mle["q"] == pytest.approx(-math.log(e(2) / (e(2) + e(1))) / 2)
    assert {r.query_id: r.pairs for r in losses.lambdarank(df).collect()} == {"q": 1, "one": 0}
    assert losses.objective_name(" Pairwise ") == "pairwise_hinge"
    with pytest.raises(ValueError):
        losses.objective_name("none")


def test_exposure_and_shadow(spark):
    df = spark.createDataFrame([("q", i, "a", 1.0, "x") for i in range(1, 5)] + [("q", 5, None, 0.5, "x")], "query_id string, rank long, cohort string, score double, title string")
    got = {r["rank"]: (round(r.penalized_score, 6), r.new_rank) for r in policy.cohort_exposure_penalty(df, 2).collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 2), 3: (0.9, 3), 4: (0.8, 4), 5: (0.5, 5)}
    slate = spark.createDataFrame([("q", "Red Bolt red", 0.97), ("", "Red", 0.5)], "query_text string, title string, score double")
    shadow = [r.shadow_score for r in policy.shadow_score(slate.withColumn("query_text", F.when(F.col("query_text") == "q", "red BOLT"))).collect()]
    assert shadow == [1.0, 0.5]
    with pytest.raises(ValueError):
        policy.diversity_rerank(df, relevance_weight=0.0)


def test_blend(spark):
    rows = [("q", "a", 0, "x", 0.2, 1.0), ("q", "b", 1, "x", 0.8, 1.0), ("q", "b", 2, "y", 5.0, 0.5)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, pos long, channel string, score double, weight double")
    got = {r.item_id: r for r in blending.blend_channels(blending.normalize_scores(df)).collect()}
    assert got["b"].score == 1.0 and got["b"].source == "blend" and got["b"].raw_scores == {"x": 0.8, "y": 5.0} and got["a"].source == "x"
    with pytest.raises(ValueError):
        blending.normalize_scores(df, "rank")


def test_bandits(spark):
    rewards = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("a", 0.0), ("b", -1.0)], "item_id string, reward double")
    assert {r.item_id: (r.alpha, r.beta) for r in bandits.beta_state(rewards).collect()} == {"a": (2.5, 2.0), "b": (1.0, 2.0)}
    slate = spark.createDataFrame([("q", "a", 0, 0.1), ("q", "b", 1, 0.9), ("q", "c", 2, 0.2)], "query_id string, item_id string, pos long, score double")
    empty = bandits.ucb_state(rewards.limit(0))
    assert [r.item_id for r in bandits.ucb_select(slate, empty, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    seeded = lambda: [(r.item_id, r.blended_score) for r in bandits.thompson_select(slate, bandits.beta_state(rewards), 3).orderBy("rank").collect()]
    assert seeded() == seeded()
    assert [r.item_id for r in bandits.thompson_select(slate, bandits.beta_state(rewards.limit(0)), 3).orderBy("rank").collect()] == ["b", "c", "a"]
    assert [r.item_id for r in bandits.epsilon_greedy_select(slate, 2, 0.0).orderBy("rank").collect()] == ["b", "c"]
    many = spark.range(2000).select(F.col("id").alias("query_id"), F.lit("a").alias("item_id"), F.lit(0).alias("pos"), F.lit(0.5).alias("score"))
    share = bandits.epsilon_greedy_select(many, 1, 0.25).filter("explored").count() / 2000
    assert 0.2 < share < 0.3


def test_explanations(spark):
    df = spark.createDataFrame([("q", 1, "Film", 1.25, "T", 0.1, 0.0, 0.3), ("q", 2, "Other", -0.5, "T", 0.0, 0.0, 0.0)], "query_id string, rank long, title string, score double, query_title string, text double, multimodal double, recency double")
    got = explain.explain_items(df, ["text", "multimodal", "recency"]).orderBy("rank").collect()
    assert got[0].rationale == "[Safety/Grounding Verified] Film is suggested for 'T' because it retained a strong ranking signal from Recency and Semantic Match. Final score 1.250."
    assert (got[0].confidence, got[1].confidence, got[1].primary_signals) == (1.0, 0.0, "Neural Alignment")
    asked = spark.createDataFrame([("q", "T"), ("none", "U")], "query_id string, query_title string")
    text = {r.query_id: r.summary for r in explain.explain_summary(asked, df).collect()}
    assert text["q"].endswith("Mean confidence score is 0.375.") and text["none"].startswith("No confident recommendations were found for 'U'.")


def test_full_explanation_text(spark):
    df = spark.createDataFrame([("q", "a", "T", 0, 0.5, "graph", 0.25, None, 0.0, 0.0, 1.0)], "query_id string, item_id string, title string, pos long, score double, channel string, text double, multimodal double, popularity double, recency double, novelty double")
    row = ranking.rank_cascade(df).first()
    assert row.explanation == "channel=graph|score=0.700000|base=0.500000|text=0.250000|multimodal=0.000000|popularity=0.000000|recency=0.000000|novelty=1.000000"
    assert row.probability == pytest.approx(1 / (1 + math.exp(-0.7))) and row.uncertainty == pytest.approx(1 - abs(2 * row.probability - 1))


def test_hashes(spark):
    row = one(spark, m=X.md5_bucket(F.lit("user-7")), v=X.hash_vector(F.lit("x"), 34), f=X.fit_vector(F.array(F.lit(1.0), F.lit(2.0)), 5), e=X.fit_vector(F.array().cast("array<double>"), 2), n=X.stable_noise(F.lit("u"), F.lit("t")))
    assert row.m == int(hashlib.md5(b"user-7").hexdigest(), 16) % 10000
    digest = hashlib.sha256(b"x").digest()
    assert row.v == [digest[i % 32] / 255.0 for i in range(34)]
    assert row.f == [1.0, 2.0, 1.0, 2.0, 1.0] and row.e == [0.0, 0.0]
    assert row.n == int(hashlib.sha256(b"u:t").hexdigest()[:8], 16) / 0xFFFFFFFF


def test_assignment(spark):
    users = spark.createDataFrame([(f"u{i}",) for i in range(300)] + [("",), (None,)], "u string")
    shares = {"t": [("control", 0.3), ("a", 0.3)]}
    got = users.select("u", experiments.assign_group(F.col("u"), "t", shares, "s").alias("g"), experiments.assign_variant("u", [("x", 0.5), ("y", 0.1)]).alias("v")).collect()
    for r in got[:300]:
        point = int(hashlib.md5(f"{r.u}_t_s".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert r.g == ("control" if point <= 0.3 else "a" if point <= 0.6 else "control")
        assert r.v == ("x" if int(hashlib.md5(r.u.encode()).hexdigest(), 16) % 10000 / 10000 <= 0.5 else "y")
    assert {r.g for r in got[300:]} == {"control"}


def test_experiment_needs_thirty_rows(spark):
    rows = [("e", v, float(i % 5 + (v == "treatment"))) for v in ("control", "treatment") for i in range(40)] + [("few", "control", 1.0)]
    got = {r.experiment: r for r in experiments.experiment_test(spark.createDataFrame(rows, "experiment string, variant string, metric double"), ["experiment"]).collect()}
    assert got["e"].lift == pytest.approx(0.5) and got["e"].p_value < 0.05 and got["e"].gate_passed
    assert got["few"].p_value == 1.0 and not got["few"].gate_passed


def test_screening_order(spark):
    texts = ["  \n ", "x" * 181, "hello <ScRipt>", "Select a thing FROM b", "see ../etc", "ignore  previous instructions", "mail me@site.org now", "call +49 30 1234567", "1234 5678 9012 3456 7890", "plain\ttext  here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in screening.screen_text(df).collect()}
    assert [got[i].reason for i in range(6)] == ["empty_input", "input_too_large", "script_injection", "sql_injection", "path_traversal", "prompt_injection"]
    assert [got[i].status for i in range(3)] == [400, 413, 400]
    assert got[6].sanitized == "mail [REDACTED_EMAIL] now" and got[6].redactions == ["email"]
    assert got[7].redactions == ["phone"] and got[8].redactions == ["phone"]
    assert got[9].sanitized == "plaintext here" and got[9].allowed


def test_word_edges_are_ascii(spark):
    texts = ["\u00e8. 27.204.213.132 4116106959541135\n\u00c9r\u00e9", "mail me@site.org\n\u00c9t\u00e9", "\u00e9select a from \u00e9b"]
    got = {r.id: r for r in screening.screen_text(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    assert got[0].redactions == ["phone"] and got[0].reason == "pii_detected"
    assert got[1].sanitized == "mail [REDACTED_EMAIL]\u00c9t\u00e9"
    assert got[2].reason == "sql_injection"


def test_forms(spark):
    field = lambda n, v: (n, v)
    forms = [(1, [field("a", "fine"), field("b", "../x"), field("c", "<script")]), (2, [field(f"f{i}", "v") for i in range(81)]), (3, [field("a", "ok")]), (4, [])]
    df = spark.createDataFrame(forms, "form_id int, fields array<struct<name:string,value:string>>")
    got = {r.form_id: (r.allowed, r.status, r.reason) for r in screening.screen_forms(df).collect()}
    assert got == {1: (False, 400, "path_traversal:b"), 2: (False, 413, "too_many_form_fields"), 3: (True, 200, "ok"), 4: (True, 200, "ok")}


def test_keyword_routing(spark):
    rows = [("a movie about a song", None), ("hip hop playlist", None), ("no idea", None), ("film and book", None), ("a book", "music"), ("a book", "games")]
    got = screening.route_by_keywords(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, want string"), override="want").orderBy("id").collect()
    assert [r.domain for r in got] == ["movies", "music", "unknown", "movies", "music", "books"]
    assert got[4].method == "user_override" and got[4].confidence == 1.0 and got[0].confidence == 0.5 and got[2].confidence == 0.0


def test_contract_kinds(spark):
    cases = {
        "user": ['{"user_id":"u","locale":"en"}', '{"user_id":5,"locale":"en","attributes":[]}', "nonsense"],
        "session": ['{"session_id":"s","user_id":null,"started_at_utc":"t","context":{"device_type":"d","cohort":"c","timezone_offset":1.5}}', '{"session_id":"s","started_at_utc":"t","context":{"device_type":"d"}}'],
        "snapshot": ['{"dataset_id":"d","version":"1","license_name":"l","source_uri":"s","snapshot_utc":"t","content_hash":"c","schema_hash":"h"}', '{"dataset_id":"d"}'],
        "event": ['{"event_id":"e","event_type":"click","occurred_at_utc":"t","item_id":null,"extra":1}', '{"event_id":"e","event_type":"view","occurred_at_utc":"t"}'],
    }
    wanted = {"user": [[], ["user_id: not string", "attributes: not object"], ["record: not JSON"]], "session": [[], ["context.cohort: missing"]], "event": [[], ["event_type: unknown"]]}
    for kind, texts in cases.items():
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, payload string")
        got = [r.violations for r in contracts.validate_records(df, kind, strict_event_type=kind == "event").orderBy("id").collect()]
        assert got == wanted[kind] if kind in wanted else (got[0] == [] and len(got[1]) == 6)
    checked = contracts.validate_records(spark.createDataFrame([("x",)], "payload string"), "user")
    with pytest.raises(ValueError):
        contracts.split_valid(checked)
    assert contracts.split_valid(checked, strict=False)[1].count() == 1


def test_profiles(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "a int, b double")
    values = {(r.column, r.metric): r.value for r in quality.profile(a).collect()}
    assert values[("b", "missing_fraction")] == pytest.approx(1 / 3) and values[("b", "unique_count")] == 2 and values[("b", "std")] == 1.0
    rough = {(r.column, r.metric): r.value for r in quality.profile(a, approximate=True).collect()}
    assert rough[("a", "unique_count")] == 3
    b = spark.createDataFrame([(1, None), (2, None), (3, 2.0)], "a int, b double")
    found = {(r.column, r.metric) for r in quality.compare_profiles(quality.profile(a), quality.profile(b)).collect()}
    assert found == {("b", "missing_fraction"), ("b", "unique_count_ratio"), ("b", "std_ratio")}
    assert quality.compare_profiles(quality.profile(a), quality.profile(a)).count() == 0


def test_features(spark):
    rows = [("a", "text", [1.0, 3.0]), ("a", "image", [3.0, 5.0]), ("b", "text", [1.0]), ("b", "image", [1.0, 2.0])]
    got = {r.item_id: r.vector for r in features.fuse_modalities(spark.createDataFrame(rows, "item_id string, modality string, vector array<double>")).collect()}
    assert got == {"a": [2.0, 4.0], "b": []}
    assert one(spark, c=X.vector_checksum(F.array(F.lit(0.5), F.lit(-1.25)))).c == hashlib.sha256(b"0.50000000,-1.25000000").hexdigest()


def test_uniformity_numbers_ids_and_meets_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(150)] + [(150, None), (151, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    ring = sorted(rows, key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0]))
    unit = [None if v is None or None in v else np.array(v) / np.linalg.norm(v) for _, v in ring]
    for n, partners, block in ((152, 32, 7), (152, 32, 64), (152, 32, 2048), (152, 500, 40)):
        steps = min(partners, n - 1)
        pairs = [(unit[i], unit[(i + s) % n]) for i in range(n) for s in range(1, steps + 1)]
        want = math.log(np.mean([math.exp(-2.0 * ((a - b) ** 2).sum()) for a, b in pairs if a is not None and b is not None]))
        got = embedding_quality.uniformity(df, partners, block=block)
        assert got.first().rows == n and abs(got.first().uniformity - want) < 1e-9
    from tests.test_coldstart_entities import _most_written

    many = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    assert _most_written(spark, lambda: embedding_quality.uniformity(many).first())[1] <= 2 * 3000


def test_checksum_rounds_the_exact_value(spark):
    values = [0.103515625, -0.166015625, 2.5e-9, float("nan"), 1e20, None]
    assert one(spark, c=X.vector_checksum(F.array(*[F.lit(v).cast("double") for v in values]))).c == hashlib.sha256(",".join("%.8f" % v for v in values[:-1]).encode()).hexdigest()


def test_vector_edges(spark):
    items = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", []), (2, "c", None)], "pos long, item_id string, vector array<double>")
    assert vectors.usable_vectors(items).count() == 1
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    with pytest.raises(ValueError):
        vectors.check_dimension(vectors.usable_vectors(items), asked)
    matrix = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0), (2, 0, 3.0)], "i int, j int, m double")
    assert vectors.map_across_domains(asked, matrix).first().embedding == [1.0, 2.0]
    assert vectors.map_across_domains(asked, matrix.limit(0)).first().embedding == [1.0, 0.0, 0.0]


def test_eventlog(spark):
    samples = spark.createDataFrame([("k", float(v), v) for v in range(1, 7)], "key string, value double, seq long")
    row = eventlog.percentiles(samples).first()
    assert (row.p50, row.p95, row.p99) == (3.0, 6.0, 6.0)  # (6 - 1) * 0.5 = 2.5 rounds to 2, the third value
    assert eventlog.percentiles(samples, hot_rows=1).first() == row
    assert eventlog.percentiles(samples, approximate=True).first().p50 == 3.0
    tagged = spark.createDataFrame([("n", {"b": "2", "a": "1"}, 2.0), ("n", None, 1.0)], "name string, tags map<string,string>, value double")
    assert {r.key: r.total for r in eventlog.counters(tagged).collect()} == {"n|a=1|b=2": 2.0, "n": 1.0}
    spans = [("t", "1", None, "root", "unset", 0.0, None), ("t", "2", "1", "x", "unset", 1.0, None), ("t", "3", "1", "x", "error", 2.0, 4.0), ("t", "4", "1", "y", "ok", 2.0, 5.0)]
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string, name string, status string, start_ms double, end_ms double")
    row = eventlog.trace_summary(df).first()
    assert (row.spans, row.errors) == (4, 2)


def test_training(spark):
    rows = [(q, i, int(x > 0.5), x, 1.0 - x, None) for q in range(12) for i, x in enumerate([0.1, 0.9, 0.4, 0.7, 0.2])]
    df = spark.createDataFrame(rows, "query_id long, pos long, label int, text double, recency double, novelty double")
    scaling = training.scale_stats(df)
    assert scaling.features == ("text", "recency", "novelty") and scaling.stds[2] == 1.0
    for objective in losses.OBJECTIVES:
        model = training.fit_linear(df, objective, training.FitConfig(epochs=3))
        scored = df.withColumn("score", ranking.linear_model_score(model))
        assert losses.auc(scored).first().auc > 0.95, objective
    name, model, table = training.champion(df, ["pointwise", "pairwise"], training.FitConfig(epochs=2))
    assert name == "pointwise_logloss" and table.filter("champion").count() == 1
    with pytest.raises(ValueError):
        training.scale_stats(df.drop("label"))


def test_factor_training(spark):
    pairs = [(u, i) for u in range(20) for i in range(20) if i % 2 == u % 2 and (u + i) % 5]
    df = spark.createDataFrame(pairs, "user_id int, item_id int")
    negatives = training.sample_negatives(df).collect()
    known = set(pairs)
    assert negatives and all((r.user_id, r.negative_id) not in known for r in negatives)
    users, items = training.pairwise_factors(df, dim=8, epochs=6, rate=0.5)
    u, v = {r.user_id: r.vector for r in users.collect()}, {r.item_id: r.vector for r in items.collect()}
    score = lambda a, b: sum(x * y for x, y in zip(u[a], v[b]))
    wins = [score(r.user_id, r.item_id) > score(r.user_id, r.negative_id) for r in negatives]
    assert sum(wins) / len(wins) > 0.7


def test_negatives_are_held_against_the_history_where_it_is(spark):
    """Picks move once, to the numbered items; rows without user or item are in nobody's history."""
    rng = np.random.default_rng(4)
    pairs = [(int(u), int(i)) for u, i in zip(rng.integers(0, 6, 90), rng.integers(0, 12, 90))] + [(None, 3), (2, None), (1, 99)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    number = lambda *parts: int(hashlib.md5("_".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)
    items = sorted({i for _, i in pairs}, key=lambda i: number(5, i))
    picks = [(u, i, items[number(5, 2, u, i, k) % len(items)]) for u, i in set(pairs) for k in range(3)]
    want = [(u, i, n) for u, i, n in picks if None in (u, n) or (u, n) not in set(pairs)]
    got = training.sample_negatives(df, round_no=2)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


def test_factor_blocks_hold_each_vector_once_and_add_up(spark):
    """One epoch in blocks is the epoch over all triples, and no vector travels to a block more than once."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 300), rng.integers(100, 130, 300))], "user_id int, item_id int")
    laid = training.factor_training(df, block_rows=20)
    assert laid.history.select("block").distinct().count() > 5
    gather = lambda rows, factors: pa.table({"side": factors["side"], "id": factors["id"], "block": pa.array([rows["block"][0].as_py()] * len(factors), pa.int32())})
    start = [{r[0]: np.array(r.vector) for r in side.collect()} for side in training.pairwise_factors(df, dim=4, epochs=0, laid=laid)]
    flat = [(0, u, v.tolist()) for u, v in start[0].items()]
    flat += [(1, r.number, start[1][r.negative_id].tolist()) for r in laid.items.collect()]
    factors = spark.createDataFrame(flat, "side int, id long, vector array<double>")
    moved = [tuple(r) for r in laid.over_blocks(factors, 0, 4, gather, "side int, id long, block int").collect()]
    assert moved and len(moved) == len(set(moved))
    sums, times = {}, {}
    for u, p, n in training.sample_negatives(df).collect():
        x, y, z = start[0][u], start[1][p], start[1][n]
        weight = 1.0 / (1.0 + np.exp(x @ (y - z)))
        for key, slope in (((0, u), weight * (y - z)), ((1, p), weight * x), ((1, n), -weight * x)):
            sums[key], times[key] = sums.get(key, 0.0) + slope, times.get(key, 0) + 1
    after = training.pairwise_factors(df, dim=4, epochs=1, rate=0.5, l2=0.0, laid=laid)
    for side in (0, 1):
        for key, *_, vector in after[side].collect():
            want = start[side][key] + (0.5 * sums[side, key] / times[side, key] if (side, key) in times else 0.0)
            assert np.allclose(vector, want, atol=1e-12)


def test_contract_checks_use_all_cores(spark):
    """A table of one split is dealt out before its records are checked."""
    rows = spark.range(40).coalesce(1).selectExpr("id AS pos", "CASE WHEN id % 2 = 0 THEN '{}' ELSE 'x' END AS payload")
    checked = contracts.validate_records(rows, "user")
    assert checked.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r.pos % 2, r.violations[0]) for r in checked.collect()} == {(0, "user_id: missing"), (1, "record: not JSON")}


def test_beta_draws_are_those_of_seeded_generators():
    rng = np.random.default_rng(6)
    keys = np.concatenate([[0, 1, 2**32 - 1, 2**32, 2**63 - 1], rng.integers(0, 2**63 - 1, 300)])
    alpha, beta = rng.uniform(0.2, 90.0, len(keys)), rng.uniform(0.2, 90.0, len(keys))
    want = [np.random.default_rng(int(k)).beta(a, b) for k, a, b in zip(keys, alpha, beta)]
    assert (bandits.beta_draws(keys, alpha, beta) == np.array(want)).all()
    assert len(bandits.beta_draws(keys[:0], alpha[:0], beta[:0])) == 0


def test_long_lists_pull_label_by_label(spark, monkeypatch):
    """Taking labels one by one gives the slopes of all pairs at once; a list's rows share a partition throughout."""
    rng = np.random.default_rng(12)
    blocks = lambda n: (rng.integers(0, 3, n).astype(float), rng.uniform(size=n), rng.normal(size=n))
    for left, right in ((blocks(40), blocks(25)), (blocks(1), blocks(30)), ((np.ones(9), np.ones(9), np.arange(9.0)),) * 2):
        side, change, ahead = losses.pair_terms(*[c[None, :] for c in (*left, *right)])
        monkeypatch.setattr(training, "LONG_PASS", 50)
        slope, half = training._long_pulls(*left, *right)
        assert np.allclose(slope, -(side * change / (1.0 + np.exp(ahead))).sum(axis=2)[0], atol=1e-12)
        assert np.allclose(half, 0.5 * (side != 0).sum(axis=2)[0])
    rows = spark.range(300).selectExpr("cast(id % 7 as string) AS query_id", "id AS pos", "cast(id % 3 as double) AS label", "array(cast(id as double)) AS x")
    placed = training._by_list(rows).withColumn("__at", F.spark_partition_id())
    assert placed.groupBy("query_id").agg(F.countDistinct("__at").alias("n")).agg(F.max("n")).first()[0] == 1


def test_embedding_quality(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "id long, vector array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 9)], "a long, b long")
    assert embedding_quality.alignment(df, pairs).first().alignment == pytest.approx(2.0)
    want = math.log((math.exp(-4) + 2 * math.exp(-2)) / 3)
    assert embedding_quality.uniformity(df).first().uniformity == pytest.approx(want)
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, vector array<double>")
    whole, drawn = (embedding_quality.uniformity(many, partners=p).first() for p in (399, 32))
    assert whole.rows == drawn.rows == 400 and drawn.uniformity == pytest.approx(whole.uniformity, abs=0.05)
    assert embedding_quality.uniformity(many, partners=32, hot_rows=50).first().uniformity == pytest.approx(drawn.uniformity)
    assert embedding_quality.uniformity(df.limit(0)).first().uniformity == 0.0


def test_centroid_routing_in_blocks(spark):
    """Scoring the classes a few at a time changes nothing, nor do ties and a lone class."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 12)), rng.normal(size=6).tolist()) for i in range(200)] + [(900, 40, [1.0] * 6), (901, 41, [1.0] * 6), (902, 40, [0.0] * 6)]
    items = spark.createDataFrame(rows, "pos long, label int, vector array<double>")
    centroids = vectors.class_centroids(items.filter("pos <> 902"))
    routed = lambda some, block: sorted((r.pos, r.route, round(r.lead, 9), round(r.confidence, 9)) for r in vectors.route_by_centroid(items, some, block=block).collect())
    whole = routed(centroids, 1000)
    assert routed(centroids, 3) == whole and routed(centroids, 1) == whole
    assert dict((p, r) for p, r, *_ in whole)[902] == "unknown" and dict((p, lead) for p, _, lead, _ in whole)[900] == 0.0
    alone = routed(centroids.filter("label = 40"), 3)
    assert {r for _, r, *_ in alone} <= {"40", "unknown"}
    with pytest.raises(ValueError):
        vectors.route_by_centroid(items, centroids.limit(0))


def test_uniformity_takes_all_pairs(spark):
    """Rows by the dozen, copies, nulls, zero vectors and two lengths, in blocks of any size."""
    rng = np.random.default_rng(6)
    drawn = [rng.normal(size=5).tolist() for _ in range(120)]
    rows = list(enumerate([*drawn, *drawn[:30], *drawn[:10], [0.0] * 5, [0.0] * 5, None, [1.0, None], *rng.normal(size=(20, 3)).tolist()]))
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    unit = [np.array(v) / (np.linalg.norm(v) or 1.0) for _, v in rows if v is not None and None not in v]
    near = [math.exp(-2.0 * ((a - b) ** 2).sum()) for i, a in enumerate(unit) for b in unit[:i] if len(a) == len(b)]
    for block in (7, 50, 64, 2048):
        got = embedding_quality.uniformity(df, block=block).first()
        assert got.rows == len(rows) and abs(got.uniformity - math.log(np.mean(near))) < 1e-9
    assert embedding_quality.uniformity(df.filter("id in (162, 163)")).first().uniformity is None
    assert embedding_quality.uniformity(df.filter("id < 1")).first().uniformity == 0.0


def test_numbers_of_whole_arrays_are_those_of_the_column(spark):
    from slatewise.functions.digests import hex_numbers

    rows = [(0, 0), (7, 12345), (-3, 99), (10**18, -(10**18)), (2**63 - 1, -(2**63)), (100, 9), (99, 10)]
    df = spark.createDataFrame(rows, "u long, p long")
    for before, last in (((5, 0), (0, 1, 2)), ((123456789, 4321), (9, 10))):
        want = df.select("u", "p", *[X.hex_number(*before, "u", "p", k).alias(f"k{k}") for k in last]).collect()
        got = hex_numbers(before, np.array([r.u for r in want]), np.array([r.p for r in want]), last)
        assert got.tolist() == [list(r[2:]) for r in want]
    assert hex_numbers((5, 0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), (0, 1)).shape == (0, 2)


def test_factor_training_keeps_rows_and_vectors_in_slices(spark, monkeypatch):
    """Neither interactions nor vectors are shuffled one by one, and slices of any size give the same factors."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(int(u), int(i)) for u, i in zip(rng.integers(-20, 40, 600), rng.integers(0, 50, 600))], "user_id int, item_id int")
    fit = lambda: [{r[0]: r.vector for r in side.collect()} for side in training.pairwise_factors(df, dim=4, epochs=2, rate=0.5)]
    whole = fit()
    laid = training.factor_training(df)
    assert laid.history.count() <= laid.blocks and laid.packed(spark.range(9000).selectExpr("1 AS side", "id", "array(0D, 1D) AS vector"), 2).count() == 3
    monkeypatch.setattr(training, "SLICE", 3)
    monkeypatch.setattr(training, "HISTORY_SLICE", 5)
    for a, b in zip(whole, fit()):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_champion_reads_its_frame_once_and_leaves_little(spark, tmp_path, monkeypatch):
    """What the frame comes from is computed once, and what an objective writes on its way is removed with it."""
    from slatewise import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(losses.auc, "__defaults__", (*losses.auc.__defaults__[:-1], 50))
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rng = np.random.default_rng(5)
    rows = [(f"q{i % 9}", i, int(rng.integers(0, 2)), float(rng.normal()), float(rng.normal())) for i in range(300)]
    frame = spark.createDataFrame(rows, "query_id string, pos long, label int, base double, text double")
    name, _, table = training.champion(frame.mapInPandas(count, frame.schema), ["pointwise", "listmle"], training.FitConfig(epochs=2))
    assert seen.value == 300 and table.count() == 2
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["frame"]
