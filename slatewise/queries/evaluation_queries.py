"""Metrics, losses, calibration, fairness, embedding quality, off-policy and experiment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.operators import embedding_quality, experiments, fairness, labels, losses, metrics, offpolicy
from slatewise.functions import expressions as X
from slatewise.queries.inputs import (
    LABELS_SQL, LOGGED_SQL, SLATES_SQL, VECTORS_SQL, events, logged_events, r6, scored_labels, slates, table, vectors,
)
from slatewise.queries.registry import query

# Recommended lists: orders; relevant: returned items of the order. Every order is a query, also the empty ones.
_METRICS_SQL = f"""{SLATES_SQL}, rel AS (SELECT DISTINCT query_id, item_id FROM slates WHERE label = 1), nrel AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
 first_at AS (SELECT query_id, item_id, min(pos) AS pos FROM slates WHERE pos < 5 GROUP BY query_id, item_id),
 hits AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM first_at SEMI JOIN rel ON rel.query_id = first_at.query_id AND rel.item_id = first_at.item_id),
 agg AS (SELECT query_id, count(*) AS h, sum(1.0 / log2(pos + 2.0)) AS dcg, min(pos) AS best, sum(nth / (pos + 1.0)) AS ps FROM hits GROUP BY query_id),
 per AS (SELECT o_orderkey AS query_id, coalesce(dcg / (SELECT sum(1.0 / log2(i + 2.0)) FROM range(5) t(i) WHERE i < nrel.n), 0.0) AS ndcg, coalesce(h::DOUBLE / nrel.n, 0.0) AS recall,
   coalesce(1.0 / (best + 1.0), 0.0) AS mrr, coalesce(ps / least(nrel.n, 5), 0.0) AS map FROM orders LEFT JOIN nrel ON nrel.query_id = o_orderkey LEFT JOIN agg ON agg.query_id = o_orderkey)"""


def _per_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder).withColumnRenamed("pos", "position")
    asked = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"))
    return metrics.ranking_metrics(rows, rows.filter(F.col("label") == 1), asked, 5)


@query(
    "ranking_metrics_per_query",
    f"WITH {_METRICS_SQL} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(map, 6) AS map FROM per",
)
def ranking_metrics_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return _per_query(spark, folder).select("query_id", *[r6(m, m) for m in ("ndcg", "recall", "mrr", "map")])


@query(
    "ranking_metrics_mean",
    f"WITH {_METRICS_SQL} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map FROM per",
)
def ranking_metrics_mean(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mean_metrics(_per_query(spark, folder)).select("queries", *[r6(m, m) for m in ("ndcg", "recall", "mrr", "map")])


@query(
    "impression_summary",
    f"""WITH {_METRICS_SQL.replace("pos < 5", "pos < 10").replace("range(5)", "range(10)").replace("least(nrel.n, 5)", "least(nrel.n, 10)").replace("FROM orders LEFT", "FROM (SELECT DISTINCT query_id AS o_orderkey FROM slates) LEFT")},
      clicks AS (SELECT DISTINCT query_id, item_id FROM slates WHERE label = 1),
      rew AS (SELECT s.query_id, CASE WHEN any_value(o.o_orderstatus) = 'F' THEN any_value(o.o_totalprice) / 100000.0 ELSE sum(s.label) END AS reward FROM slates s LEFT JOIN orders o ON o.o_orderkey = s.query_id GROUP BY s.query_id)
      SELECT (SELECT count(*) FROM per) AS impressions, (SELECT count(*) FROM slates) AS shown, (SELECT count(*) FROM clicks) AS clicks,
       round((SELECT count(*) FROM clicks)::DOUBLE / (SELECT count(*) FROM slates), 6) AS ctr, round((SELECT avg(reward) FROM rew), 6) AS mean_reward,
       round((SELECT count(DISTINCT item_id) FROM slates)::DOUBLE / (SELECT count(*) FROM slates), 6) AS coverage, round((SELECT avg(ndcg) FROM per), 6) AS ndcg,
       round((SELECT avg(mrr) FROM per), 6) AS mrr, round((SELECT avg(map) FROM per), 6) AS map, round((SELECT avg(recall) FROM per), 6) AS recall, (SELECT count(DISTINCT item_id) FROM slates) AS unique_items""",
)
def impression_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder).select(F.col("query_id").alias("impression_id"), F.col("pos").alias("position"), "item_id", (F.col("label") == 1).alias("clicked"))
    given = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("impression_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 100000.0).alias("reward")
    )
    done = metrics.impression_summary(rows, rows.filter("clicked"), given)
    return done.select("impressions", "shown", "clicks", "unique_items", *[r6(c, c) for c in ("ctr", "mean_reward", "coverage", "ndcg", "mrr", "map", "recall")])


@query(
    "calibration_error",
    f"""WITH {LABELS_SQL}, b AS (SELECT least(CAST(floor(least(greatest(prediction, 0), 1) * 10) AS INT), 9) AS bin, prediction AS p, label FROM scored),
      g AS (SELECT count(*) AS n, avg(p) AS c, avg(label) AS y, sum((p - label) * (p - label)) AS b FROM b GROUP BY bin)
      SELECT sum(n)::BIGINT AS rows, round(sum(n * abs(c - y)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM g""",
)
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration(scored_labels(spark, folder)).select("rows", r6("ece", "ece"), r6("brier", "brier"))


@query(
    "pointwise_losses",
    f"""WITH {LABELS_SQL}, c AS (SELECT label, least(greatest(prediction, 1e-12), 1 - 1e-12) AS p FROM scored)
      SELECT count(*) AS rows, round(avg(-label * ln(p) - (1 - label) * ln(1 - p)), 6) AS log_loss,
       round(avg(CASE WHEN label > 0 THEN -0.25 * pow(1 - p, 2) * ln(p) ELSE -0.75 * pow(p, 2) * ln(1 - p) END), 6) AS focal_loss FROM c""",
)
def pointwise_losses(spark: SparkSession, folder: str) -> DataFrame:
    return losses.pointwise_losses(scored_labels(spark, folder)).select("rows", r6("log_loss", "log_loss"), r6("focal_loss", "focal_loss"))


@query(
    "pairwise_hinge_loss",
    f"""WITH {SLATES_SQL} SELECT q.query_id, count(p.score) AS pairs, round(coalesce(sum(p.h), 0), 6) AS loss_sum, round(coalesce(avg(p.h), 0), 6) AS loss FROM (SELECT DISTINCT query_id FROM slates) q
      LEFT JOIN (SELECT a.query_id, a.score, greatest(0.0, 1.0 - a.score + b.score) AS h FROM slates a JOIN slates b ON a.query_id = b.query_id WHERE a.label > 0 AND b.label <= 0) p ON p.query_id = q.query_id GROUP BY q.query_id""",
)
def pairwise_hinge_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.pairwise_hinge(slates(spark, folder)).select("query_id", "pairs", r6("loss_sum", "loss_sum"), r6("loss", "loss"))


@query(
    "listwise_softmax_loss",
    f"""WITH {SLATES_SQL}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM slates), p AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM m)
      SELECT query_id, round(avg(-label * ln(least(greatest(p, 1e-12), 1.0))), 6) AS loss FROM p GROUP BY query_id""",
)
def listwise_softmax_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.listwise_softmax(slates(spark, folder)).select("query_id", r6("loss", "loss"))


_LISTMLE_SQL = f"WITH {SLATES_SQL}" + """, t AS (SELECT {g} AS g, score, sum(exp(score)) OVER (PARTITION BY {g} ORDER BY label DESC, {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM slates)
      SELECT g AS query_id, round(avg(-ln(least(greatest(exp(score) / m, 1e-12), 1.0))), 6) AS loss FROM t GROUP BY g"""


@query("listmle_loss", _LISTMLE_SQL.format(g="query_id", o="pos"))
def listmle_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.listmle(slates(spark, folder)).select("query_id", r6("loss", "loss"))


@query("listmle_loss_ranges", _LISTMLE_SQL.format(g="pos", o="query_id"))
def listmle_loss_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The lines in the same place of all orders as one list: a few long lists, laid out in ranges of 10,000 or so, larger ones where those would be too many."""
    lists = slates(spark, folder).select(F.col("pos").alias("query_id"), F.col("query_id").alias("pos"), "label", "score")
    return losses.listmle(lists, hot_rows=10_000).select("query_id", r6("loss", "loss"))


_GRADED_SQL = f"""{SLATES_SQL}, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) - 1 AS place, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, pos) - 1 AS best FROM slates)"""


@query(
    "lambdarank_loss",
    f"""WITH {_GRADED_SQL}, ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(best + 2)) AS i FROM pl GROUP BY query_id),
      x AS (SELECT a.query_id, abs((pow(2, a.grade) - 1) / log2(a.place + 2) - (pow(2, b.grade) - 1) / log2(b.place + 2)) * ln(1 + exp(-(a.score - b.score))) AS t FROM pl a JOIN pl b ON a.query_id = b.query_id AND a.grade > b.grade)
      SELECT i.query_id, count(x.t) AS pairs, round(coalesce(avg(x.t) / any_value(i.i), 0), 6) AS loss FROM ideal i LEFT JOIN x ON x.query_id = i.query_id GROUP BY i.query_id""",
)
def lambdarank_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder).withColumn("label", F.col("grade"))
    return losses.lambdarank(rows).select("query_id", "pairs", r6("loss", "loss"))


@query(
    "graded_ndcg",
    f"""WITH {_GRADED_SQL} SELECT query_id, round(CASE WHEN max(grade) = 0 THEN 0.0 ELSE sum(CASE WHEN pos < 3 THEN (pow(2, grade) - 1) / log2(pos + 2) ELSE 0 END) /
       sum(CASE WHEN best < 3 THEN (pow(2, grade) - 1) / log2(best + 2) ELSE 0 END) END, 6) AS ndcg FROM pl GROUP BY query_id""",
)
def graded_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder).withColumn("label", F.col("grade"))
    return losses.graded_ndcg(rows, 3).select("query_id", r6("ndcg", "ndcg"))


@query(
    "distillation_loss",
    f"""WITH {SLATES_SQL}, s AS (SELECT query_id, label, exp(score / 2.0) AS es, exp(quantity / 50.0 / 2.0) AS et, exp(score) AS eh FROM slates),
      p AS (SELECT query_id, label, es / sum(es) OVER w AS ps, et / sum(et) OVER w AS pt, eh / sum(eh) OVER w AS ph FROM s WINDOW w AS (PARTITION BY query_id))
      SELECT query_id, round(0.5 * sum(-pt * ln(ps + 1e-12) * 4.0) + 0.5 * sum(-label * ln(ph + 1e-12)), 6) AS loss FROM p GROUP BY query_id""",
)
def distillation_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder).select("query_id", "label", F.col("score").alias("student"), (F.col("quantity") / 50.0).alias("teacher"))
    return losses.distillation(rows).select("query_id", r6("loss", "loss"))


_AUC_SQL = """r AS (SELECT {g} AS g, label, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS k FROM {t})
 SELECT {o}sum((label > 0)::INT)::BIGINT AS positives, sum((label <= 0)::INT)::BIGINT AS negatives,
 round(CASE WHEN sum((label > 0)::INT) = 0 OR sum((label <= 0)::INT) = 0 THEN 0.5 ELSE (sum(CASE WHEN label > 0 THEN k ELSE 0 END) - sum((label > 0)::INT) * (sum((label > 0)::INT) + 1) / 2.0) / (sum((label > 0)::INT) * sum((label <= 0)::INT)) END, 6) AS auc FROM r GROUP BY g"""


_AUC_OVERALL_SQL = f"WITH {LABELS_SQL}, {_AUC_SQL.format(g='1', t='scored', o='')}"


@query("auc_overall", _AUC_OVERALL_SQL)
def auc_overall(spark: SparkSession, folder: str) -> DataFrame:
    return losses.auc(scored_labels(spark, folder)).select("positives", "negatives", r6("auc", "auc"))


@query("auc_overall_ranges", _AUC_OVERALL_SQL)
def auc_overall_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same area over ranges of at most 100 scores or so."""
    return losses.auc(scored_labels(spark, folder), hot_rows=100).select("positives", "negatives", r6("auc", "auc"))


@query("auc_per_query", f"WITH {LABELS_SQL}, {_AUC_SQL.format(g='query_id', t='scored', o='g AS query_id, ')}")
def auc_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return losses.auc(scored_labels(spark, folder), group=("query_id",)).select("query_id", "positives", "negatives", r6("auc", "auc"))


# Exposure: order lines are slots; cohort = part type, provider = brand; popularity = lines of a part.
@query(
    "cohort_exposure",
    """WITH s AS (SELECT p_type AS c, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1), k AS (SELECT p_type AS c, count(*) AS n FROM part GROUP BY 1)
      SELECT coalesce(s.c, k.c) AS cohort, coalesce(s.n, 0) AS item_count, round(coalesce(s.n, 0)::DOUBLE / (SELECT sum(n) FROM s), 6) AS exposure_share, round(coalesce(k.n, 0)::DOUBLE / (SELECT sum(n) FROM k), 6) AS ideal_share,
       round(coalesce(s.n, 0)::DOUBLE / (SELECT sum(n) FROM s) - coalesce(k.n, 0)::DOUBLE / (SELECT sum(n) FROM k), 6) AS gap FROM s FULL JOIN k ON s.c = k.c""",
)
def cohort_exposure(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "part").groupBy(F.col("p_type").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    done = fairness.cohort_exposure(_slots(spark, folder), counts)
    return done.select("cohort", "item_count", r6("exposure_share", "exposure_share"), r6("ideal_share", "ideal_share"), r6("gap", "gap"))


def _slots(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("item_id"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("cohort"), F.col("p_brand").alias("provider"))
    return lines.join(parts, "item_id")


def _popularity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count(F.lit(1)).alias("popularity"))


_TAIL_SQL = """pop AS (SELECT l_partkey AS item, count(*) AS v FROM lineitem GROUP BY 1), lim AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM pop) WHERE i = (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM pop)),
 tail AS (SELECT item FROM pop WHERE v <= (SELECT v FROM lim)), slots AS (SELECT l_partkey AS item, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'), seen AS (SELECT DISTINCT item FROM slots SEMI JOIN tail USING (item)),
 tc AS (SELECT (SELECT count(*) FROM tail) AS tail_items, (SELECT count(*) FROM seen) AS recommended_tail_items, (SELECT count(*) FROM seen)::DOUBLE / (SELECT count(*) FROM slots) AS long_tail_ratio, (SELECT count(*) FROM seen)::DOUBLE / (SELECT count(*) FROM tail) AS coverage)"""


@query(
    "long_tail_coverage",
    f"WITH {_TAIL_SQL} SELECT tail_items, recommended_tail_items, round(long_tail_ratio, 6) AS long_tail_ratio, round(coverage, 6) AS coverage FROM tc",
)
def long_tail_coverage(spark: SparkSession, folder: str) -> DataFrame:
    done = fairness.long_tail_coverage(_slots(spark, folder), _popularity(spark, folder))
    return done.select("tail_items", "recommended_tail_items", r6("long_tail_ratio", "long_tail_ratio"), r6("coverage", "coverage"))


_GINI_SQL = """pv AS (SELECT p_brand, count(*) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1), pi AS (SELECT v, row_number() OVER (ORDER BY v, p_brand) AS i, count(*) OVER () AS n, sum(v) OVER () AS t FROM pv),
 pc AS (SELECT max(n) AS providers, sum((2.0 * i - n - 1) * v) / (max(n) * max(t)) AS gini, max(v)::DOUBLE / max(t) AS top_share FROM pi)"""


@query("provider_concentration", f"WITH {_GINI_SQL} SELECT providers, round(gini, 6) AS gini, round(top_share, 6) AS top_share FROM pc")
def provider_concentration(spark: SparkSession, folder: str) -> DataFrame:
    return fairness.provider_concentration(_slots(spark, folder)).select("providers", r6("gini", "gini"), r6("top_share", "top_share"))


@query(
    "fairness_report",
    f"""WITH {_TAIL_SQL}, {_GINI_SQL}, s AS (SELECT p_type AS c, count(*) AS n FROM slots GROUP BY 1), k AS (SELECT p_type AS c, count(*) AS n FROM part GROUP BY 1),
      g AS (SELECT max(abs(coalesce(s.n, 0)::DOUBLE / (SELECT sum(n) FROM s) - coalesce(k.n, 0)::DOUBLE / (SELECT sum(n) FROM k))) AS gap FROM s FULL JOIN k ON s.c = k.c)
      SELECT round(gap, 6) AS exposure_gap, round(coverage, 6) AS coverage, round(gini, 6) AS gini, gap <= 0.10 AS passes_exposure, coverage >= 0.05 AS passes_coverage FROM g, tc, pc""",
)
def fairness_report(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "part").groupBy(F.col("p_type").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    done = fairness.fairness_report(_slots(spark, folder), counts, _popularity(spark, folder))
    return done.select(r6("exposure_gap", "exposure_gap"), r6("coverage", "coverage"), r6("gini", "gini"), "passes_exposure", "passes_coverage")


_UNIT_SQL = f"{VECTORS_SQL}, u AS (SELECT pos, label, vector, sqrt(list_dot_product(vector, vector)) AS n FROM vectors)"


@query(
    "embedding_alignment",
    f"""WITH {_UNIT_SQL}, p AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem)
      SELECT count(*) AS pairs, round(avg(2.0 - 2.0 * list_cosine_similarity(x.vector, y.vector)), 6) AS alignment FROM p JOIN u x ON x.pos = p.a JOIN u y ON y.pos = p.b""",
)
def embedding_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    rows = vectors(spark, folder).select(F.col("pos").alias("id"), "vector")
    return embedding_quality.alignment(rows, pairs).select("pairs", r6("alignment", "alignment"))


@query(
    "embedding_uniformity",
    f"""WITH {VECTORS_SQL}
      SELECT (SELECT count(*) FROM vectors) AS rows, round(ln(avg(exp(-2.0 * (2.0 - 2.0 * list_cosine_similarity(a.vector, b.vector))))), 6) AS uniformity FROM vectors a JOIN vectors b ON a.pos < b.pos""",
)
def embedding_uniformity(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).select(F.col("pos").alias("id"), "vector")
    return embedding_quality.uniformity(rows).select("rows", r6("uniformity", "uniformity"))


@query("embedding_anisotropy")
def embedding_anisotropy(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_quality.anisotropy(vectors(spark, folder).select("vector")).select("dimension", r6("anisotropy", "anisotropy"))


_RATIO = "CASE WHEN {p} > 0 AND target_propensity > 0 THEN least(greatest(target_propensity / {p}, 0.1), 5.0) END"
_EST = """SELECT experiment, '{name}' AS name, round(coalesce(avg(x), 0), 6) AS value, count(x) AS n, round(sqrt(CASE WHEN count(x) < 2 THEN 0 ELSE var_samp(x) END), 6) AS deviation,
 round(avg(x) - 1.96 * sqrt(var_samp(x) / count(x)), 6) AS lower, round(avg(x) + 1.96 * sqrt(var_samp(x) / count(x)), 6) AS upper FROM ({rows}) GROUP BY experiment"""


def _ips_sql(name: str, factor: str) -> str:
    ratio = _RATIO.format(p=f"(logging_propensity * {factor})")
    return _EST.format(name=name, rows=f"SELECT experiment, {ratio} * reward AS x FROM logged")


_DR_SQL = _EST.format(
    name="doubly_robust", rows=f"SELECT experiment, coalesce(direct_estimate, 0) + {_RATIO.format(p='logging_propensity')} * (reward - coalesce(direct_estimate, 0)) AS x FROM logged"
)
_SNIPS_SQL = f"""SELECT experiment, 'snips' AS name, round(any_value(m), 6) AS value, count(x) AS n, round(sqrt(sum((x - m) * (x - m)) / (count(x) - 1)), 6) AS deviation,
 round(any_value(m) - 1.96 * sqrt(sum((x - m) * (x - m)) / (count(x) - 1) / count(x)), 6) AS lower, round(any_value(m) + 1.96 * sqrt(sum((x - m) * (x - m)) / (count(x) - 1) / count(x)), 6) AS upper
 FROM (SELECT experiment, w * reward AS x, sum(w * reward) OVER (PARTITION BY experiment) / sum(w) OVER (PARTITION BY experiment) AS m FROM (SELECT *, {_RATIO.format(p='logging_propensity')} AS w FROM logged)) GROUP BY experiment"""
_P = "greatest(1e-6, least(1 - 1e-6, logging_propensity))"
_CAUSAL_ROWS = f"""SELECT experiment, CASE WHEN target_propensity > logging_propensity THEN d + (reward - d) / {_P} - d ELSE d - (d + (reward - d) / (1 - {_P})) END AS x
 FROM (SELECT *, coalesce(direct_estimate, 0) AS d FROM logged)"""
_CAUSAL_SQL = _EST.format(name="causal_ate", rows=_CAUSAL_ROWS)


def _rounded(estimates: DataFrame) -> DataFrame:
    """The deviation instead of the variance: clipped propensities give variances beyond 6 exact decimals."""
    return estimates.select("experiment", "name", "n", r6(F.sqrt("variance"), "deviation"), *[r6(c, c) for c in ("value", "lower", "upper")])


@query("off_policy_report", f"WITH {LOGGED_SQL} {_ips_sql('ips', '1.0')} UNION ALL {_SNIPS_SQL} UNION ALL {_DR_SQL} UNION ALL {_CAUSAL_SQL}")
def off_policy_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(offpolicy.off_policy_report(logged_events(spark, folder), ["experiment"], 0.1, 5.0))


@query("off_policy_sensitivity", f"WITH {LOGGED_SQL} " + " UNION ALL ".join(_ips_sql(f"ips_perturbed_{f:.2f}", str(f)) for f in offpolicy.FACTORS))
def off_policy_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(offpolicy.sensitivity(logged_events(spark, folder), ["experiment"], clip_min=0.1, clip_max=5.0))


_TREAT_SQL = """tr AS (SELECT user_id % 7 AS experiment, (event_id % 3 = 0)::INT AS treatment, value / 100.0 AS outcome, 0.05::DOUBLE + (event_id % 10) / 11.0::DOUBLE AS propensity,
 user_id / 200.0::DOUBLE AS y0, user_id / 180.0::DOUBLE AS y1, greatest(1e-6, least(1 - 1e-6, 0.05::DOUBLE + (event_id % 10) / 11.0::DOUBLE)) AS p FROM events)"""
_ATE_SQL = _EST.format(name="ate_ipw", rows="SELECT experiment, CASE WHEN treatment = 1 THEN outcome / p ELSE -outcome / (1 - p) END AS x FROM tr")
_ATE_DR_ROWS = "SELECT experiment, CASE WHEN treatment = 1 THEN y1 + (outcome - y1) / p - y0 ELSE y1 - (y0 + (outcome - y0) / (1 - p)) END AS x FROM tr"


def _treated(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.col("user_id") % 7).alias("experiment"),
        (F.col("event_id") % 3 == 0).cast("int").alias("treatment"),
        (F.col("value") / 100.0).alias("outcome"),
        (0.05 + (F.col("event_id") % 10) / 11.0).alias("propensity"),
        (F.col("user_id") / 200.0).alias("y0"),
        (F.col("user_id") / 180.0).alias("y1"),
    )


@query("treatment_effects", f"WITH {_TREAT_SQL} {_ATE_SQL} UNION ALL {_EST.format(name='ate_dr', rows=_ATE_DR_ROWS)}")
def treatment_effects(spark: SparkSession, folder: str) -> DataFrame:
    rows = _treated(spark, folder)
    return _rounded(offpolicy.ate_weighted(rows, ["experiment"]).unionByName(offpolicy.ate_doubly_robust(rows, ["experiment"])))


@query(
    "causal_guardrail",
    f"""WITH {_TREAT_SQL}, e AS (SELECT experiment, avg(x) AS v, avg(x) - 1.96 * sqrt(var_samp(x) / count(x)) AS l FROM ({_ATE_DR_ROWS}) GROUP BY experiment)
      SELECT experiment, NOT (v < 0.01 OR l < 0) AS passed, CASE WHEN v < 0.01 THEN printf('ATE %.4f is below minimum threshold %.4f.', v, 0.01::DOUBLE)
       WHEN l < 0 THEN printf('Lower confidence bound %.4f is below zero, effect not statistically significant.', l) ELSE 'Experiment passed causal guardrails.' END AS reason FROM e""",
)
def causal_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    effects = offpolicy.ate_doubly_robust(_treated(spark, folder), ["experiment"])
    return offpolicy.causal_guardrail(effects).select("experiment", "passed", "reason")


_VARIANTS = [("control", 0.5), ("treatment", 0.3), ("holdout", 0.2)]


@query(
    "variant_assignment",
    """WITH h AS (SELECT c_custkey, md5(c_name) AS m FROM customer), c AS (SELECT c_custkey, ('0x' || substr(m, 1, 8))::BIGINT AS a, ('0x' || substr(m, 9, 8))::BIGINT AS b, ('0x' || substr(m, 17, 8))::BIGINT AS c, ('0x' || substr(m, 25, 8))::BIGINT AS d FROM h),
      p AS (SELECT c_custkey, ((((((a % 10000) * 7296 + b) % 10000) * 7296 + c) % 10000) * 7296 + d) % 10000 / 10000.0::DOUBLE AS p FROM c)
      SELECT c_custkey AS user_id, CASE WHEN p <= 0.5 THEN 'control' WHEN p <= 0.8 THEN 'treatment' ELSE 'holdout' END AS variant FROM p""",
)
def variant_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """4294967296 mod 10000 is 7296, hence the factor in the SQL."""
    users = table(spark, folder, "customer")
    return users.select(F.col("c_custkey").alias("user_id"), experiments.assign_variant("c_name", _VARIANTS).alias("variant"))


_EXPERIMENTS = {"ranking_test": [("control", 0.5), ("treatment", 0.5)]}
_GROUP_SQL = "CASE WHEN ('0x' || substr(md5(CAST(user_id AS VARCHAR) || '_ranking_test_s1'), 1, 8))::BIGINT / 4294967295.0::DOUBLE <= 0.5 THEN 'control' ELSE 'treatment' END"


@query("group_assignment", f"SELECT event_id, {_GROUP_SQL} AS variant FROM events")
def group_assignment(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, folder, "events").select("event_id", experiments.assign_group(user, "ranking_test", _EXPERIMENTS, "s1").alias("variant"))


_TEST_SQL = f"""g AS (SELECT event_type AS experiment, {_GROUP_SQL} AS variant, value AS metric FROM events),
 s AS (SELECT experiment, count(*) FILTER (variant = 'control') AS n_a, avg(metric) FILTER (variant = 'control') AS a, var_samp(metric) FILTER (variant = 'control') AS va,
  count(*) FILTER (variant = 'treatment') AS n_b, avg(metric) FILTER (variant = 'treatment') AS b, var_samp(metric) FILTER (variant = 'treatment') AS vb FROM g GROUP BY experiment)"""


def _tested(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("experiment"), experiments.assign_group(user, "ranking_test", _EXPERIMENTS, "s1").alias("variant"), F.col("value").alias("metric")
    )
    return experiments.experiment_test(rows, ["experiment"])


@query("experiment_lift", f"WITH {_TEST_SQL} SELECT experiment, n_a, n_b, round((b - a) / a, 6) AS lift, round((b - a) / sqrt(va / n_a + vb / n_b), 6) AS z FROM s")
def experiment_lift(spark: SparkSession, folder: str) -> DataFrame:
    return _tested(spark, folder).select("experiment", "n_a", "n_b", r6("lift", "lift"), r6("z", "z"))


# The normal tail as a power series: 1 - 2 phi(z) sum z^(2n+1) / (2n+1)!!.
@query(
    "experiment_p_value",
    f"""WITH {_TEST_SQL}, z AS (SELECT experiment, (b - a) / a AS lift, abs((b - a) / sqrt(va / n_a + vb / n_b)) AS z FROM s),
      t AS (SELECT experiment, sum(exp((2 * n + 1) * ln(z) - lgamma(2.0 * n + 2) + n * ln(2.0) + lgamma(n + 1.0))) AS m FROM z, range(300) r(n) WHERE z > 0 GROUP BY experiment),
      p AS (SELECT experiment, lift, coalesce(1.0 - 2.0 * exp(-z * z / 2.0) / sqrt(2.0 * pi()) * m, 1.0) AS p FROM z LEFT JOIN t USING (experiment))
      SELECT experiment, round(p, 6) AS p_value, p < 0.05 AS significant, p < 0.05 AND lift >= 0.05 AS gate_passed FROM p""",
)
def experiment_p_value(spark: SparkSession, folder: str) -> DataFrame:
    return _tested(spark, folder).select("experiment", r6("p_value", "p_value"), "significant", "gate_passed")


@query(
    "release_gate",
    f"""WITH {_TEST_SQL}, z AS (SELECT experiment, abs((b - a) / sqrt(va / n_a + vb / n_b)) > 1.959963984540054 AND (b - a) / a >= 0.05 AS gate FROM s)
      SELECT experiment, gate AND true AND (SELECT avg(value) FROM events) >= 0.01 AS released FROM z""",
)
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Fairness flag: the exposure gap of the slots is within its limit; causal flag: the mean value is above the least effect."""
    counts = table(spark, folder, "part").groupBy(F.col("p_type").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    gap = fairness.cohort_exposure(_slots(spark, folder), counts).agg(F.max(F.abs("gap")).alias("gap"))
    effect = table(spark, folder, "events").agg(F.avg("value").alias("effect"))
    joined = _tested(spark, folder).join(F.broadcast(gap)).join(F.broadcast(effect))
    return joined.select("experiment", experiments.release_gate(F.col("gate_passed"), F.col("gap") <= 0.10, F.col("effect") >= 0.01).alias("released"))


_DELAYS_SQL = """d AS (SELECT user_id, event_id, label, delay FROM (SELECT user_id, event_id, event_type, (nxt IS NOT NULL)::INT AS label, epoch_us(nxt)::DOUBLE / 3.6e9 - epoch_us(ts)::DOUBLE / 3.6e9 AS delay FROM (
   SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nxt FROM events)) WHERE event_type IN ('signup', 'view')),
 hist AS (SELECT ceil(delay / 6.0) * 6.0 AS max_hours, count(*)::DOUBLE AS n FROM d WHERE delay IS NOT NULL GROUP BY 1),
 dist AS (SELECT max_hours, n / sum(n) OVER () AS share, least(1.0, sum(n) OVER (ORDER BY max_hours) / sum(n) OVER ()) AS cdf FROM hist)"""


def _delays(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = labels.delays_from_events(events(spark, folder), ("signup", "view"), ("purchase",))
    known = rows.filter(F.col("delay_hours").isNotNull())
    histogram = known.groupBy((F.ceil(F.col("delay_hours") / 6.0) * 6.0).alias("max_hours")).agg(F.count(F.lit(1)).alias("n"))
    return rows, labels.delay_distribution(histogram)


@query("delay_distribution", f"WITH {_DELAYS_SQL} SELECT max_hours, round(share, 6) AS share, round(cdf, 6) AS cdf, round(1.0 - cdf, 6) AS survival FROM dist")
def delay_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return _delays(spark, folder)[1].select("max_hours", r6("share", "share"), r6("cdf", "cdf"), r6("survival", "survival"))


# Delays younger than a day still count as negatives, older ones as positives; no purchase means no delay.
@query(
    "delayed_label_weights",
    f"""WITH {_DELAYS_SQL}, l AS (SELECT user_id, event_id, CASE WHEN delay > 24 THEN 1 ELSE 0 END AS label, delay FROM d),
      c AS (SELECT l.*, (SELECT coalesce(min(cdf) FILTER (max_hours >= l.delay), max(cdf)) FROM dist) AS cdf FROM l),
      w AS (SELECT *, 1.0 - pow(1.0 - cdf, 1.5) AS sv, pow(cdf, 2) AS df FROM c), k AS (SELECT *, unnest(['cdf', 'survival_weighted', 'defer', 'defuse']) AS strategy FROM w)
      SELECT event_id, strategy, round(CASE WHEN label = 1 THEN 1.0 WHEN delay IS NULL THEN 0.05 ELSE least(greatest(CASE strategy WHEN 'cdf' THEN cdf WHEN 'survival_weighted' THEN sv WHEN 'defer' THEN df ELSE 0.6 * df + 0.4 * sv END, 0.05), 1.0) END, 6) AS weight,
       CASE WHEN label = 1 THEN 'positive' WHEN delay IS NULL THEN 'missing_delay' ELSE 'delayed_negative:' || strategy END AS reason FROM k""",
)
def delayed_label_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows, distribution = _delays(spark, folder)
    rows = rows.withColumn("label", F.coalesce(F.col("delay_hours") > 24, F.lit(False)).cast("int"))
    merged = labels.adjust_by_strategies(rows, distribution)
    return merged.select("event_id", "strategy", r6("weight", "weight"), "reason")


@query(
    "survival_weighted_loss",
    f"""WITH {_DELAYS_SQL} SELECT event_id, round(CASE WHEN label > 0 THEN 1.0 ELSE 1.0 / least(greatest(exp(-0.1 * (event_id % 50)), 1e-6), 1.0) END, 6) AS weight,
      round(ln(2.0) * CASE WHEN label > 0 THEN 1.0 ELSE 1.0 / least(greatest(exp(-0.1 * (event_id % 50)), 1e-6), 1.0) END, 6) AS loss FROM d""",
)
def survival_weighted_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _delays(spark, folder)
    weight = labels.survival_weight(F.col("label"), F.col("event_id") % 50)
    raw = X.log_loss(F.col("label").cast("double"), F.lit(0.5))
    return rows.select("event_id", r6(weight, "weight"), r6(raw * weight, "loss"))
