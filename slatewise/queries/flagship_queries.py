"""The end-to-end path: all catalogue titles, and all segment names as unknown titles, asked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.operators import bandits, graph
from slatewise.plans.recommend import RecommendConfig, recommend
from slatewise.queries.inputs import catalog, r6, table
from slatewise.queries.ranking_queries import _UCB_SQL, _rewards
from slatewise.queries.registry import query
from slatewise.queries.retrieval_queries import _COMB_SQL, _STRUCT_SQL

_RECOMMEND_SQL = f"""WITH {_COMB_SQL}, {_STRUCT_SQL},
 tch AS (SELECT query_id, sims.pos AS pos, text, 0.02 AS mm, text + 0.02 AS score, 'hybrid_text_multimodal' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY text DESC, sims.pos) AS rk
   FROM sims JOIN firsts ON firsts.pos = sims.query_id JOIN catalog c ON c.pos = sims.pos WHERE c.title <> firsts.title),
 gch AS (SELECT f.pos AS query_id, s.pos, 0.0 AS text, 0.0 AS mm, 0.3 * s.score AS score, 'graph' AS channel, 2000000 + s.rank AS rk
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM graph_sims JOIN catalog USING (pos) WHERE title <> query_id) s JOIN firsts f ON f.title = s.query_id WHERE rank <= 20),
 allc AS (SELECT * FROM tch WHERE rk <= 200 UNION ALL SELECT * FROM gch),
 merged AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY score DESC, rk) AS w, min(rk) OVER (PARTITION BY query_id, pos) AS place FROM allc),
 tot AS (SELECT *, score + 0.4 * text + 0.4 * mm AS total FROM merged WHERE w = 1),
 pre AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, place) AS pr FROM tot),
 fine AS (SELECT p.*, c.title, c.provider, c.genre FROM pre p JOIN catalog c USING (pos) WHERE pr <= 10),
 pen AS (SELECT *, total - CASE WHEN n > 3 THEN (n - 3) * 0.1 ELSE 0.0 END AS ps FROM (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY pr) AS n FROM fine)),
 pol AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ps DESC, pr) AS plr FROM pen),
 div AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN g >= 2 THEN 1 ELSE 0 END, CASE WHEN g >= 2 THEN 0.0 ELSE 0.25 * g - 0.75 * ps END, plr) AS dr
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id, genre ORDER BY ps DESC, plr) - 1 AS g FROM pol))
 SELECT f.title AS query_title, d.pos, round(ps, 6) AS score, channel, row_number() OVER (PARTITION BY d.query_id ORDER BY dr) AS rank FROM div d JOIN firsts f ON f.pos = d.query_id"""


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = catalog(spark, folder)
    items = base.withColumn("text", F.concat_ws(" ", "title", "genre", "provider")).withColumn("attribute_count", F.size(F.split("genre", " ")))
    metadata = base.select("item_id", F.col("provider").alias("cohort"), F.col("genre").alias("category"))
    edges = graph.catalog_edges(base, {"provider": "director"}, "genre")
    return items, edges, metadata


def _title_requests(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("title").alias("query_id"), F.col("title").alias("query_title"), F.lit(None).cast("string").alias("user_id"), F.lit(0.1).alias("meta_score")
    ).distinct()


@query("recommend_known_titles", _RECOMMEND_SQL)
def recommend_known_titles(spark: SparkSession, folder: str) -> DataFrame:
    items, edges, metadata = _parts(spark, folder)
    done = recommend(_title_requests(items), items, edges, metadata=metadata)
    return done.select("query_title", F.col("item_id").cast("long").alias("pos"), r6("score", "score"), "channel", "rank")


# The bandit's order of the merged candidates takes the place of the order in which they were listed.
_EXPLORED_SQL = _RECOMMEND_SQL.replace("WITH ", f"WITH {_UCB_SQL}, ", 1).replace(
    " tot AS (SELECT *, score + 0.4 * text + 0.4 * mm AS total FROM merged WHERE w = 1),",
    """ pulled AS (SELECT merged.*, 0.5 * score + 0.5 * coalesce(least(1.0, mean_reward + sqrt(2.0) * sqrt(ln((SELECT sum(pulls) FROM state)::DOUBLE) / pulls)), 1.0) AS blended
   FROM merged LEFT JOIN state ON item_id = pos WHERE w = 1),
 tot AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, place) AS place, score + 0.4 * text + 0.4 * mm AS total FROM pulled),""",
)


@query("recommend_explored_titles", _EXPLORED_SQL)
def recommend_explored_titles(spark: SparkSession, folder: str) -> DataFrame:
    """All catalogue titles, with a UCB policy between merging and ranking."""
    items, edges, metadata = _parts(spark, folder)
    state = bandits.ucb_state(_rewards(spark, folder).withColumn("item_id", F.col("item_id").cast("string")))
    done = recommend(_title_requests(items), items, edges, metadata=metadata, explore=lambda rows, k: bandits.ucb_select(rows, state, k))
    return done.select("query_title", F.col("item_id").cast("long").alias("pos"), r6("score", "score"), "channel", "rank")


@query("recommend_mixed_batch")
def recommend_mixed_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Known titles with the vector channel, and customers asking for titles the catalogue does not have."""
    from slatewise.queries.inputs import vectors

    items, edges, metadata = _parts(spark, folder)
    user = F.lit(None).cast("string").alias("user_id")
    known = items.select(F.col("title").alias("query_id"), F.col("title").alias("query_title"), user, F.lit(0.1).alias("meta_score")).distinct()
    unknown = table(spark, folder, "supplier").select(
        F.col("s_name").alias("query_id"), F.concat(F.lit("small red "), F.col("s_name")).alias("query_title"), user, F.lit(0.1).alias("meta_score")
    )
    done = recommend(known.unionByName(unknown), items, edges, vectors(spark, folder), metadata, config=RecommendConfig())
    return done.select("query_id", "rank", "item_id", "title", r6("score", "score"), r6("shadow_score", "shadow_score"), "channel")
