"""Scoring, cascade, policy, explanation and exploration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators import bandits, explain, policy, ranking
from slatewise.operators.ranking import LinearModel
from slatewise.operators.scale import numbered
from slatewise.queries.inputs import SLATES_SQL, r6, slates, table
from slatewise.queries.registry import query

# Candidates: the lines shipped by a supplier, with signals taken from other columns; position = order key and place.
_CAND_SQL = """cand AS (SELECT l_suppkey AS query_id, l_partkey AS item_id, p_name AS title, p_brand AS cohort, p_type AS category, 'shipped' AS channel,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos,
   sqrt(l_extendedprice / 100000.0) AS score, l_discount AS text, l_tax AS multimodal, 1.0 - l_partkey / 20000.0 AS popularity,
   CASE WHEN l_returnflag = 'R' THEN l_quantity / 50.0 END AS recency, l_partkey / 20000.0 AS novelty FROM lineitem JOIN part ON p_partkey = l_partkey),
 pre AS (SELECT *, score + 0.4 * coalesce(text, 0) + 0.4 * coalesce(multimodal, 0) + 0.2 * coalesce(popularity, 0) + 0.1 * coalesce(recency, 0) + 0.1 * coalesce(novelty, 0) AS total FROM cand),
 pre_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, pos) AS pre_rank FROM pre),
 fine AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, pre_rank) AS rank FROM pre_ranked WHERE pre_rank <= 50)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_quantity"
    )
    placed = numbered(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "pos")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    return placed.join(parts, "l_partkey").select(
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("cohort"),
        F.col("p_type").alias("category"),
        F.lit("shipped").alias("channel"),
        "pos",
        F.sqrt(F.col("l_extendedprice") / 100000.0).alias("score"),
        F.col("l_discount").alias("text"),
        F.col("l_tax").alias("multimodal"),
        (1.0 - F.col("l_partkey") / 20000.0).alias("popularity"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 50.0).alias("recency"),
        (F.col("l_partkey") / 20000.0).alias("novelty"),
    )


@query(
    "score_breakdown",
    f"""WITH {_CAND_SQL} SELECT query_id, pos, round(total, 6) AS total, round(1.0 / (1.0 + exp(-total)), 6) AS probability,
      round(1.0 - abs(2.0 / (1.0 + exp(-total)) - 1.0), 6) AS uncertainty FROM pre""",
)
def score_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    done = ranking.score_breakdown(candidates(spark, folder))
    return done.select("query_id", "pos", r6("total", "total"), r6("probability", "probability"), r6("uncertainty", "uncertainty"))


@query(
    "explanation_text",
    f"""WITH {_CAND_SQL} SELECT query_id, pos, format('channel={{}}|base={{:.4f}}|text={{:.6f}}|multimodal={{:.6f}}|recency={{:.6f}}', channel, score, text, multimodal, coalesce(recency, 0.0)) AS explanation FROM pre""",
)
def explanation_text(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the explanation that both engines print alike; the full text is tested by hand-computed values."""
    done = ranking.score_breakdown(candidates(spark, folder))
    parts = F.format_string("channel=%s|base=%.4f|text=%.6f|multimodal=%.6f|recency=%.6f", "channel", "base", "text", "multimodal", "recency")
    return done.select("query_id", "pos", parts.alias("explanation"))


@query(
    "pre_rank",
    f"WITH {_CAND_SQL} SELECT query_id, pos, round(total, 6) AS pre_score, pre_rank FROM pre_ranked WHERE pre_rank <= 50",
)
def pre_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.pre_rank(candidates(spark, folder)).select("query_id", "pos", r6("pre_score", "pre_score"), "pre_rank")


@query("rank_cascade", f"WITH {_CAND_SQL} SELECT query_id, pos, round(total, 6) AS score, rank FROM fine WHERE rank <= 10")
def rank_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_cascade(candidates(spark, folder)).select("query_id", "pos", r6("score", "score"), "rank")


_MODEL = LinearModel(("score", "text", "multimodal", "popularity", "recency", "novelty"), (0.5, 0.3, -0.2, 0.4, 0.1, 0.05), 0.25, (0.5, 0.05, 0.04, 0.5, 0.2, 0.5), (0.3, 0.03, 0.02, 0.3, 0.3, 0.0))


@query(
    "rank_by_linear_model",
    f"""WITH {_CAND_SQL}, m AS (SELECT *, 0.25 + 0.5 * ((score - 0.5) / 0.3) + 0.3 * ((text - 0.05) / 0.03) - 0.2 * ((multimodal - 0.04) / 0.02)
       + 0.4 * ((popularity - 0.5) / 0.3) + 0.1 * ((coalesce(recency, 0) - 0.2) / 0.3) + 0.05 * (novelty - 0.5) AS model_score FROM cand)
      SELECT query_id, pos, round(model_score, 6) AS model_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, pos) AS rank FROM m) WHERE rank <= 10""",
)
def rank_by_linear_model(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_by_model(candidates(spark, folder), _MODEL, 10).select("query_id", "pos", r6("model_score", "model_score"), "rank")


@query(
    "cohort_exposure_penalty",
    f"""WITH {_CAND_SQL}, seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY rank) AS n FROM fine),
      pen AS (SELECT *, total - CASE WHEN n > 3 THEN (n - 3) * 0.1 ELSE 0.0 END AS p FROM seen)
      SELECT query_id, pos, round(p, 6) AS penalized_score, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank) AS new_rank FROM pen""",
)
def cohort_exposure_penalty(spark: SparkSession, folder: str) -> DataFrame:
    fine = ranking.rank_cascade(candidates(spark, folder), 50, 50)
    done = policy.cohort_exposure_penalty(fine, cohort="category", hot_rows=None)
    return done.select("query_id", "pos", r6("penalized_score", "penalized_score"), "new_rank")


@query(
    "diversity_rerank",
    f"""WITH {_CAND_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY total DESC, rank) - 1 AS n FROM fine)
      SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n >= 2 THEN 1 ELSE 0 END,
        CASE WHEN n >= 2 THEN 0.0 ELSE 0.25 * n - 0.75 * total END, rank) AS new_rank FROM nth""",
)
def diversity_rerank(spark: SparkSession, folder: str) -> DataFrame:
    fine = ranking.rank_cascade(candidates(spark, folder), 50, 50)
    grouped = fine.withColumn("group_key", X.diversity_group(F.col("title"), F.col("category")))
    return policy.diversity_rerank(grouped, hot_rows=None).select("query_id", "pos", "new_rank")


@query(
    "diversity_group_key",
    """SELECT p_partkey AS pos, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, ''), nullif(CASE WHEN p_size % 2 = 0 THEN p_brand END, ''),
      nullif(string_split(lower(trim(p_name)), ' ')[1], ''), 'unknown') AS group_key FROM part""",
)
def diversity_group_key(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    category = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    genre = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return parts.select(F.col("p_partkey").alias("pos"), X.diversity_group(F.col("p_name"), category, genre).alias("group_key"))


@query(
    "shadow_score",
    f"""WITH {SLATES_SQL}, named AS (SELECT s.*, lower(c.c_mktsegment || ' small Red') AS q, p.p_name FROM slates s JOIN orders o ON o.o_orderkey = s.query_id
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN part p ON p.p_partkey = s.item_id)
      SELECT query_id, pos, len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(lower(p_name), ' ')))) AS word_overlap,
        round(least(1.0, score + 0.05 * len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(lower(p_name), ' '))))), 6) AS shadow_score FROM named""",
)
def shadow_score(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("c_custkey"))
    asked = orders.join(table(spark, folder, "customer"), "c_custkey").select("query_id", F.concat("c_mktsegment", F.lit(" small Red")).alias("query_text"))
    titles = table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    named = slates(spark, folder).join(asked, "query_id").join(titles, "item_id")
    return policy.shadow_score(named).select("query_id", "pos", F.col("word_overlap").cast("long").alias("word_overlap"), r6("shadow_score", "shadow_score"))


@query(
    "explained_items",
    f"""WITH {_CAND_SQL}, s AS (SELECT query_id, pos, rank, total, unnest([struct_pack(n := 'Semantic Match', v := text, i := 0), struct_pack(n := 'Multimodal Fusion', v := multimodal, i := 1),
        struct_pack(n := 'Recency', v := coalesce(recency, 0.0), i := 2)]) AS e FROM fine WHERE rank <= 5),
      o AS (SELECT query_id, pos, e.n AS n, row_number() OVER (PARTITION BY query_id, pos ORDER BY e.v DESC, e.i) AS k FROM s WHERE e.v > 0),
      j AS (SELECT query_id, pos, string_agg(n, ' and ' ORDER BY k) AS names FROM o WHERE k <= 2 GROUP BY query_id, pos)
      SELECT f.query_id, f.rank, coalesce(names, 'Neural Alignment') AS primary_signals, round(least(1.0, greatest(0.0, f.total)), 6) AS confidence
      FROM fine f LEFT JOIN j ON j.query_id = f.query_id AND j.pos = f.pos WHERE f.rank <= 5""",
)
def explained_items(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking.rank_cascade(candidates(spark, folder)).withColumn("query_title", F.col("query_id").cast("string"))
    done = explain.explain_items(ranked, ["text", "multimodal", "recency"])
    return done.select("query_id", "rank", "primary_signals", r6("confidence", "confidence"))


@query(
    "explanation_summary",
    f"""WITH {_CAND_SQL} SELECT s_suppkey AS query_id, round(avg(total), 6) AS mean_score, bool_or(total IS NOT NULL) AS found
      FROM supplier LEFT JOIN fine ON query_id = s_suppkey AND rank <= 5 GROUP BY s_suppkey""",
)
def explanation_summary(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query_title"))
    done = explain.explain_summary(asked, ranking.rank_cascade(candidates(spark, folder)))
    return done.select("query_id", r6("mean_score", "mean_score"), F.col("summary").startswith("Recommendations for").alias("found"))


_REWARDS_SQL = "rewards AS (SELECT l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN sqrt(l_discount) ELSE 0.0 END AS reward FROM lineitem)"


def _rewards(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    reward = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", F.sqrt("l_discount")).otherwise(0.0)
    return lines.select(F.col("l_partkey").alias("item_id"), reward.alias("reward"))


@query(
    "bandit_beta_state",
    f"WITH {_REWARDS_SQL} SELECT item_id, round(1.0 + sum(CASE WHEN reward > 0 THEN reward ELSE 0 END), 6) AS alpha, 1.0 + sum(CASE WHEN reward > 0 THEN 0 ELSE 1 END)::DOUBLE AS beta FROM rewards GROUP BY item_id",
)
def bandit_beta_state(spark: SparkSession, folder: str) -> DataFrame:
    return bandits.beta_state(_rewards(spark, folder)).select("item_id", r6("alpha", "alpha"), "beta")


_UCB_SQL = f"{_REWARDS_SQL}, state AS (SELECT item_id, count(*) AS pulls, avg(reward) AS mean_reward FROM rewards GROUP BY item_id)"


@query("bandit_ucb_state", f"WITH {_UCB_SQL} SELECT item_id, pulls, round(mean_reward, 6) AS mean_reward FROM state")
def bandit_ucb_state(spark: SparkSession, folder: str) -> DataFrame:
    return bandits.ucb_state(_rewards(spark, folder)).select("item_id", "pulls", r6("mean_reward", "mean_reward"))


@query(
    "bandit_ucb_select",
    f"""WITH {_UCB_SQL}, {SLATES_SQL}, b AS (SELECT s.query_id, s.pos, 0.5 * s.score + 0.5 * coalesce(least(1.0, mean_reward + sqrt(2.0) * sqrt(ln((SELECT sum(pulls) FROM state)::DOUBLE) / pulls)), 1.0) AS v
        FROM slates s LEFT JOIN state ON state.item_id = s.item_id AND s.item_id % 5 <> 0)
      SELECT query_id, pos, round(v, 6) AS blended_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 12) DESC, pos) AS rank FROM b) WHERE rank <= 3""",
)
def bandit_ucb_select(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth item id plays the part of an unseen item on the slate side."""
    state = bandits.ucb_state(_rewards(spark, folder))
    rows = slates(spark, folder).withColumn("item_id", F.when(F.col("item_id") % 5 != 0, F.col("item_id")).otherwise(-F.col("item_id") - 1))
    return bandits.ucb_select(rows, state, 3).select("query_id", "pos", r6("blended_score", "blended_score"), "rank")


@query("bandit_thompson_select")
def bandit_thompson_select(spark: SparkSession, folder: str) -> DataFrame:
    picked = bandits.thompson_select(slates(spark, folder), bandits.beta_state(_rewards(spark, folder)), 3)
    return picked.select("query_id", "pos", r6("blended_score", "blended_score"), "rank")


@query(
    "bandit_epsilon_greedy",
    f"""WITH {SLATES_SQL}, c AS (SELECT *, ('0x' || substr(md5('7_coin_' || query_id), 1, 15))::BIGINT / pow(16.0, 15) < 0.05 AS explored, ('0x' || substr(md5('7_' || query_id || '_' || item_id || '_' || pos), 1, 15))::BIGINT::DOUBLE AS mixed FROM slates)
      SELECT query_id, pos, explored, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN explored THEN mixed ELSE -score END, pos) AS rank FROM c) WHERE rank <= 3""",
)
def bandit_epsilon_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return bandits.epsilon_greedy_select(slates(spark, folder), 3).select("query_id", "pos", "explored", "rank")
