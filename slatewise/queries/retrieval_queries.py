"""Cold start, vector, text, graph and blending queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.operators import blending, coldstart, graph, text_similarity, vectors as V
from slatewise.operators.cells import build_index, open_index
from slatewise.operators.scale import by_shuffle
from slatewise.queries.inputs import CATALOG_SQL, SLATES_SQL, VECTORS_SQL, catalog, r6, slates, table, vectors
from slatewise.queries.registry import query
from slatewise.session import work_folder

# Requests: every supplier, asking with the name of the part it shipped last.
REQUESTS_SQL = """requests AS (SELECT s.s_suppkey AS query_id, s.s_name AS user_id, p.p_name AS query_text,
    least(greatest((s.s_acctbal / 10000.0 + 0.5) / 5.0, 0.0), 1.0) AS meta_score
  FROM supplier s JOIN (SELECT l_suppkey, max(struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber, p := l_partkey)) AS m
    FROM lineitem GROUP BY l_suppkey) x ON x.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = x.m.p)"""

WORD_SETS_SQL = """word_sets AS (SELECT title, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM (
    SELECT query_text AS title FROM requests UNION SELECT p_name FROM part))"""

COLD_SQL = f"""{CATALOG_SQL}, {REQUESTS_SQL}, {WORD_SETS_SQL}, n AS (SELECT count(*)::DOUBLE AS total FROM part),
 overlap AS (SELECT a.title AS q, b.title AS t, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE
   len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS lexical
   FROM word_sets a CROSS JOIN word_sets b),
 noise AS (SELECT r.query_id, t.title, ('0x' || substr(sha256(r.user_id || ':' || t.title), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS noise
   FROM requests r CROSS JOIN (SELECT DISTINCT title FROM catalog) t),
 scored AS (SELECT r.query_id, r.query_text, c.pos, c.title, o.lexical, z.noise, 1.0 - c.pos / greatest(1, total - 1) AS prior,
   o.lexical * 0.40 + z.noise * 0.05 + (1.0 - c.pos / greatest(1, total - 1)) * 0.15 + r.meta_score * 0.20
   + exp(c.pos * (-ln(2.0) / 50.0)) * 0.20 AS score
   FROM requests r CROSS JOIN catalog c JOIN overlap o ON o.q = r.query_text AND o.t = c.title
   JOIN noise z ON z.query_id = r.query_id AND z.title = c.title CROSS JOIN n)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    last = lines.groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("m"))
    last = last.select(F.col("l_suppkey").alias("s_suppkey"), F.col("m.l_partkey").alias("p_partkey"))
    joined = table(spark, folder, "supplier").join(by_shuffle(last), "s_suppkey").join(by_shuffle(table(spark, folder, "part")), "p_partkey")
    zero = F.lit(0.0)
    return joined.select(
        F.col("s_suppkey").alias("query_id"),
        F.col("s_name").alias("user_id"),
        F.col("p_name").alias("query_text"),
        coldstart.meta_prior(F.col("s_acctbal") / 10000.0, zero, F.lit(0.5), zero, zero).alias("meta_score"),
    )


@query(
    "cold_start_candidates",
    f"""WITH {COLD_SQL} SELECT query_id, pos, title, round(lexical, 6) AS lexical_score, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 200""",
)
def cold_start_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = coldstart.cold_start_candidates(requests(spark, folder), catalog(spark, folder))
    return found.select("query_id", "pos", "title", r6("lexical_score", "lexical_score"), r6("score", "score"), "rank")


@query(
    "cold_start_new_user",
    f"""WITH {COLD_SQL} SELECT query_id, pos, round(score - 0.05 * noise, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score - 0.05 * noise DESC, pos) AS rank FROM scored) WHERE rank <= 20""",
)
def cold_start_new_user(spark: SparkSession, folder: str) -> DataFrame:
    anonymous = requests(spark, folder).withColumn("user_id", F.lit(None).cast("string"))
    weights = coldstart.ColdStartWeights(top_k=20)
    found = coldstart.cold_start_candidates(anonymous, catalog(spark, folder), weights)
    return found.select("query_id", "pos", r6("score", "score"), "rank")


def _shipped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("pos")).distinct()


@query(
    "cold_start_decisions",
    f"""WITH {COLD_SQL} SELECT query_id, pos, round(lexical, 6) AS lexical_score, round(prior, 6) AS prior_score, round(noise, 6) AS noise_score,
      round(score, 6) AS final_score, score >= 0.3 AS included, CASE WHEN score >= 0.3 THEN 'scored_new_item' ELSE 'below_threshold_new_item' END AS reason
      FROM scored SEMI JOIN lineitem ON l_suppkey = query_id AND l_partkey = pos""",
)
def cold_start_decisions(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog(spark, folder)
    pairs = _shipped(spark, folder).join(requests(spark, folder), "query_id").join(items.select("pos", "title"), "pos")
    decided = coldstart.cold_start_decisions(pairs, items.count(), coldstart.ColdStartWeights(threshold=0.3))
    return decided.select(
        "query_id", "pos", r6("lexical_score", "lexical_score"), r6("prior_score", "prior_score"), r6("noise_score", "noise_score"),
        r6("final_score", "final_score"), "included", "reason",
    )


@query(
    "cold_start_top_up",
    f"""WITH {COLD_SQL} SELECT query_id, pos, rank FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank
      FROM scored ANTI JOIN lineitem ON l_suppkey = query_id AND l_partkey = pos) WHERE rank <= 10""",
)
def cold_start_top_up(spark: SparkSession, folder: str) -> DataFrame:
    return coldstart.top_up(requests(spark, folder), catalog(spark, folder), _shipped(spark, folder), 10).select("query_id", "pos", "rank")


@query(
    "cold_start_class",
    """WITH i AS (SELECT o_custkey AS u, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
      cu AS (SELECT u, count(*) AS n FROM i GROUP BY u), cp AS (SELECT p, count(*) AS n FROM i GROUP BY p)
      SELECT mode, count(*) AS pairs FROM (SELECT CASE WHEN cu.n < 25 AND cp.n < 25 THEN 'full_cold' WHEN cu.n < 25 THEN 'new_user'
      WHEN cp.n < 25 THEN 'new_item' ELSE 'warm' END AS mode FROM (SELECT DISTINCT u, p FROM i) x JOIN cu USING (u) JOIN cp USING (p)) GROUP BY mode""",
)
def cold_start_class(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    bought = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    classed = coldstart.cold_start_class(bought, bought.distinct(), 25, 25)
    return classed.groupBy("mode").agg(F.count(F.lit(1)).alias("pairs"))


_PAIR_SCORES = f"""{VECTORS_SQL}, pairs AS (SELECT a.pos AS query_id, b.pos AS pos, a.domain AS qd, b.domain AS d,
   round(list_cosine_similarity(a.vector, b.vector), 12) AS score FROM vectors a CROSS JOIN vectors b)"""


@query(
    "vector_exact_search",
    f"""WITH {_PAIR_SCORES} SELECT query_id, pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, pos) AS rank FROM pairs WHERE qd = d) WHERE rank <= 10""",
)
def vector_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    items = vectors(spark, folder)
    asked = items.select(F.col("pos").alias("query_id"), F.col("vector").alias("embedding"), "domain")
    V.check_dimension(items, asked)
    return V.exact_search(V.usable_vectors(items), asked, 10).select("query_id", "pos", r6("score", "score"), "rank")


@query(
    "vector_filtered_search",
    f"""WITH {_PAIR_SCORES} SELECT query_id, pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, pos) AS rank FROM pairs WHERE d = '3' AND pos IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) WHERE rank <= 5""",
)
def vector_filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    items = vectors(spark, folder)
    allowed = table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").cast("string").alias("item_id"))
    asked = items.select(F.col("pos").alias("query_id"), F.col("vector").alias("embedding"))
    found = V.exact_search(V.filter_items(items, "3", allowed), asked, 5)
    return found.select("query_id", "pos", r6("score", "score"), "rank")


@query(
    "vector_similar_items",
    f"""WITH {_PAIR_SCORES} SELECT query_id, pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, pos) AS rank FROM pairs WHERE query_id <> pos) WHERE rank <= 10""",
)
def vector_similar_items(spark: SparkSession, folder: str) -> DataFrame:
    return V.similar_items(vectors(spark, folder), 10).select("query_id", "pos", r6("score", "score"), "rank")


@query(
    "vector_approximate_search",
    "SELECT count(*) AS queries, count(*) * 10 AS returned, true AS all_exact, true AS recalled FROM embeddings",
)
def vector_approximate_search(spark: SparkSession, folder: str) -> DataFrame:
    """How many results come back from an index of many cells, whether their scores are those of the exact search, and whether
    nine in ten are found. The index is written once and opened again for the search."""
    items = vectors(spark, folder)
    asked = items.select(F.col("pos").alias("query_id"), F.col("vector").alias("embedding"))
    kept = work_folder(spark, "vector-index")
    build_index(items.select("pos", "vector"), 10, 64, kept)
    near = V.approximate_search(open_index(spark, kept), asked, 10).withColumnRenamed("score", "near")
    exact = V.exact_search(items, asked, 10).select("query_id", "pos", "score")
    joined = near.join(exact, ["query_id", "pos"], "left")
    wrong = F.sum((F.abs(F.col("near") - F.col("score")) > 1e-9).cast("int"))
    return joined.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("returned"),
        (F.coalesce(wrong, F.lit(0)) == 0).alias("all_exact"),
        (F.count("score") >= 0.9 * F.count(F.lit(1))).alias("recalled"),
    )


@query("vector_index_stats", "SELECT max(len(embedding)) AS dimension, count(*) AS items FROM embeddings")
def vector_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return V.index_stats(V.usable_vectors(vectors(spark, folder)))


# The matrix of the cross-domain map is derived from the data: mean vector of each class, as columns.
@query(
    "vector_cross_domain_map",
    f"""WITH {VECTORS_SQL}, cells AS (SELECT pos, label, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS i FROM vectors),
      m AS (SELECT i, label AS j, avg(v) AS m FROM cells GROUP BY i, label)
      SELECT pos AS query_id, j, round(sum(v * m), 6) AS x FROM cells JOIN m USING (i) GROUP BY pos, j""",
)
def vector_cross_domain_map(spark: SparkSession, folder: str) -> DataFrame:
    items = vectors(spark, folder)
    cells = items.select("label", F.posexplode("vector").alias("i", "v"))
    matrix = cells.groupBy("i", F.col("label").alias("j")).agg(F.avg("v").alias("m"))
    asked = items.select(F.col("pos").alias("query_id"), F.col("vector").alias("embedding"))
    mapped = V.map_across_domains(asked, matrix)
    return mapped.select("query_id", F.posexplode("embedding").alias("j", "x")).select("query_id", "j", r6("x", "x"))


@query(
    "user_vector_recall",
    f"""WITH {VECTORS_SQL}, truth AS (SELECT DISTINCT o_custkey AS u, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
      users AS (SELECT pos AS u, vector FROM vectors WHERE pos IN (SELECT u FROM truth)),
      found AS (SELECT u, p FROM (SELECT a.u, b.pos AS p, row_number() OVER (PARTITION BY a.u ORDER BY round(list_cosine_similarity(a.vector, b.vector), 12) DESC, b.pos) AS r
        FROM users a CROSS JOIN vectors b) WHERE r <= 20),
      per AS (SELECT t.u, count(f.p)::DOUBLE / count(*) AS recall FROM truth t JOIN users USING (u) LEFT JOIN found f ON f.u = t.u AND f.p = t.p GROUP BY t.u)
      SELECT count(*) AS users, round(avg(recall), 6) AS recall FROM per""",
)
def user_vector_recall(spark: SparkSession, folder: str) -> DataFrame:
    items = vectors(spark, folder)
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    bought = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id"))
    users = items.select(F.col("pos").alias("user_id"), "vector")
    return V.user_recall(users, items, bought, 20).select("users", r6("recall", "recall"))


@query(
    "centroid_routing",
    f"""WITH {VECTORS_SQL}, cells AS (SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS i FROM vectors),
      means AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM cells GROUP BY label, i) GROUP BY label),
      s AS (SELECT v.pos, m.label, greatest(0.0, list_cosine_similarity(v.vector, m.c)) AS sim FROM vectors v CROSS JOIN means m),
      r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY sim DESC, label) AS n FROM s),
      t AS (SELECT a.pos, a.label, a.sim, a.sim - b.sim AS lead FROM r a JOIN r b ON a.pos = b.pos AND a.n = 1 AND b.n = 2)
      SELECT pos, CASE WHEN lead < 0.15 THEN 'unknown' ELSE CAST(label AS VARCHAR) END AS route, round(CASE WHEN lead < 0.15 THEN lead ELSE sim END, 6) AS confidence FROM t""",
)
def centroid_routing(spark: SparkSession, folder: str) -> DataFrame:
    items = vectors(spark, folder)
    routed = V.route_by_centroid(items, V.class_centroids(items))
    return routed.select("pos", "route", r6("confidence", "confidence"))


_WORDS = r"'[\p{L}\p{N}_]{2,}'"
_TF_SQL = f"""dtf AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_WORDS})) AS w FROM documents) GROUP BY doc_id, w),
 qtf AS (SELECT item_id, w, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {_WORDS})) AS w FROM benchmark) GROUP BY item_id, w)"""


@query("bag_of_words", f"WITH {_TF_SQL} SELECT doc_id, w AS token, tf::BIGINT AS tf FROM dtf")
def bag_of_words(spark: SparkSession, folder: str) -> DataFrame:
    return text_similarity.bag_of_words(table(spark, folder, "documents"))


_TEXT_TOP_K_SQL = f"""WITH {_TF_SQL}, dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dtf GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY item_id),
      dots AS (SELECT item_id, doc_id, sum(q.tf * d.tf) AS s FROM qtf q JOIN dtf d USING (w) GROUP BY item_id, doc_id),
      sims AS (SELECT b.item_id AS query_id, d.doc_id AS pos, round(coalesce(s / (qn.n * dn.n), 0.0), 12) AS score FROM benchmark b CROSS JOIN documents d
        LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN dn ON dn.doc_id = d.doc_id)
      SELECT query_id, pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM sims) WHERE rank <= 10"""


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pos"), "text")
    return docs, table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("text_similarity_top_k", _TEXT_TOP_K_SQL)
def text_similarity_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return text_similarity.text_top_k(*_texts(spark, folder), 10).select("query_id", "pos", r6("score", "score"), "rank")


@query("text_postings_top_k", _TEXT_TOP_K_SQL)
def text_postings_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The same answers by blocks of queries and parts of the texts, the way of query sets that are too large to travel."""
    found = text_similarity.text_top_k(*_texts(spark, folder), 10, broadcast_queries=0)
    return found.select("query_id", "pos", r6("score", "score"), "rank")


# Text channel: every distinct title asks from its first catalogue row; text = title, type and brand.
_COMB_SQL = f"""{CATALOG_SQL}, comb AS (SELECT pos, title, len(string_split(genre, ' ')) AS attrs FROM catalog),
 tf AS (SELECT pos, w, count(*)::DOUBLE AS n FROM (SELECT pos, unnest(regexp_extract_all(lower(title || ' ' || genre || ' ' || provider), {_WORDS})) AS w FROM catalog) GROUP BY pos, w),
 lengths AS (SELECT pos, sqrt(sum(n * n)) AS l FROM tf GROUP BY pos),
 firsts AS (SELECT title, min(pos) AS pos FROM catalog GROUP BY title),
 dots AS (SELECT a.pos AS query_id, b.pos AS pos, sum(a.n * b.n) AS d FROM tf a JOIN tf b ON a.w = b.w GROUP BY a.pos, b.pos),
 sims AS (SELECT a.pos AS query_id, b.pos AS pos, round(coalesce(d, 0.0) / (x.l * y.l), 12) AS text FROM catalog a JOIN catalog b ON a.pos <> b.pos
   LEFT JOIN dots ON dots.query_id = a.pos AND dots.pos = b.pos JOIN lengths x ON x.pos = a.pos JOIN lengths y ON y.pos = b.pos)"""


def _with_text(items: DataFrame) -> DataFrame:
    return items.withColumn("text", F.concat_ws(" ", "title", "genre", "provider")).withColumn("attribute_count", F.size(F.split("genre", " ")))


def _title_queries(items: DataFrame) -> DataFrame:
    first = items.groupBy("title").agg(F.min("pos").alias("pos"))
    return items.join(first, ["title", "pos"], "left_semi").select(F.col("pos").alias("query_id"), F.col("pos").alias("self_pos"), F.col("title").alias("query_title"), "text")


@query(
    "text_channel",
    f"""WITH {_COMB_SQL} SELECT query_id, pos, round(text, 6) AS text, round(text + 0.02 * attrs, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text DESC, pos) AS rank FROM sims SEMI JOIN firsts ON firsts.pos = sims.query_id) r
      JOIN comb USING (pos) WHERE rank <= 200""",
)
def text_channel(spark: SparkSession, folder: str) -> DataFrame:
    items = _with_text(catalog(spark, folder))
    found = text_similarity.text_candidates(items, _title_queries(items), 200)
    return found.select("query_id", "pos", r6("text", "text"), r6("score", "score"), "rank")


@query(
    "similar_titles",
    f"""WITH {_COMB_SQL} SELECT query_id, pos, round(text, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text DESC, pos) AS rank FROM sims) WHERE rank <= 10""",
)
def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    return text_similarity.similar_titles(_with_text(catalog(spark, folder)), 10).select("query_id", "pos", r6("score", "score"), "rank")


_GRAPH_SQL = """edges AS (
  SELECT 'movie_title' AS st, p_name AS s, 'movie' AS dt, CAST(p_partkey AS VARCHAR) AS d, 'is_movie' AS relation FROM part
  UNION ALL SELECT 'movie', CAST(p_partkey AS VARCHAR), 'director', lower(p_brand), 'directed_by' FROM part
  UNION ALL SELECT 'movie_title', p_name, 'director', lower(p_brand), 'directed_by' FROM part
  UNION ALL SELECT 'movie', CAST(p_partkey AS VARCHAR), 'genre', lower(p_type), 'has_genre' FROM part
  UNION ALL SELECT 'movie_title', p_name, 'genre', lower(p_type), 'has_genre' FROM part),
 adj AS (SELECT st || '/' || s AS a, dt || '/' || d AS b FROM edges UNION ALL SELECT dt || '/' || d, st || '/' || s FROM edges)"""


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.catalog_edges(catalog(spark, folder), {"provider": "director"}, "genre")


@query("graph_edges", f"WITH {_GRAPH_SQL} SELECT st AS src_type, s AS src, dt AS dst_type, d AS dst, relation, 1.0 AS weight FROM edges")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query("graph_vertices", f"WITH {_GRAPH_SQL} SELECT st AS type, s AS id FROM edges UNION SELECT dt, d FROM edges")
def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.catalog_vertices(_edges(spark, folder))


@query("graph_neighbours", f"WITH {_GRAPH_SQL} SELECT a AS node, b AS neighbour, count(*) AS times FROM adj GROUP BY a, b")
def graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    slash = lambda c: F.translate(c, "\u001f", "/").alias(c)
    return graph.neighbours(_edges(spark, folder)).select(slash("node"), slash("neighbour")).groupBy("node", "neighbour").agg(F.count(F.lit(1)).alias("times"))


_STRUCT_SQL = f"""{_GRAPH_SQL}, links AS (SELECT DISTINCT a, b FROM adj), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a),
 both_sides AS (SELECT q.a AS qa, c.a AS ca, count(*) AS m FROM links q JOIN links c ON q.b = c.b WHERE q.a LIKE 'movie_title/%' AND c.a LIKE 'movie/%' GROUP BY q.a, c.a),
 graph_sims AS (SELECT substr(qa, 13) AS query_id, CAST(substr(ca, 7) AS BIGINT) AS pos, m::DOUBLE / (x.n + y.n - m) AS score FROM both_sides JOIN deg x ON x.a = qa JOIN deg y ON y.a = ca),
 structural AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM graph_sims) WHERE rank <= 20)"""


def _structural(spark: SparkSession, folder: str) -> DataFrame:
    titles = catalog(spark, folder).select(F.col("title").alias("query_id"), F.lit("movie_title").alias("type"), F.col("title").alias("id")).distinct()
    return graph.structural_search(_edges(spark, folder), titles, 20)


@query("graph_structural_search", f"WITH {_STRUCT_SQL} SELECT query_id, pos, round(score, 6) AS score, rank FROM structural")
def graph_structural_search(spark: SparkSession, folder: str) -> DataFrame:
    return _structural(spark, folder).select("query_id", "pos", r6("score", "score"), "rank")


@query(
    "graph_neighbour_mean",
    f"""WITH {_GRAPH_SQL}, f AS (SELECT 'movie/' || CAST(p_partkey AS VARCHAR) AS node, p_size::DOUBLE AS v FROM part),
      m AS (SELECT a AS node, avg(f.v) AS mean FROM adj JOIN f ON f.node = adj.b GROUP BY a),
      h1 AS (SELECT f.node, f.v AS v0, coalesce(m.mean, 0.0) AS v1 FROM f LEFT JOIN m USING (node))
      SELECT node, round(v0, 6) AS own, round(v1, 6) AS mean FROM h1 UNION ALL
      SELECT 'director/' || lower(p_brand), NULL, round(avg(p_size), 6) FROM part GROUP BY lower(p_brand)""",
)
def graph_neighbour_mean(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    sized = catalog(spark, folder).select(
        F.concat(F.lit("movie\u001f"), F.col("pos").cast("string")).alias("node"), F.array(F.col("size").cast("double")).alias("vector")
    )
    own = graph.neighbour_mean(edges, sized, 1)
    # Brands have no vector of their own: give them a zero one and keep only the mean.
    brands = edges.filter(F.col("dst_type") == "director").select(F.concat(F.lit("director\u001f"), F.col("dst")).alias("node")).distinct()
    both = graph.neighbour_mean(edges.filter(F.col("src_type") == "movie"), sized.unionByName(brands.withColumn("vector", F.array(F.lit(0.0)))), 1)
    slash = F.translate("node", "\u001f", "/").alias("node")
    mine = own.select(slash, r6(F.col("vector")[0], "own"), r6(F.col("vector")[1], "mean"))
    theirs = both.filter(F.col("node").startswith("director")).select(slash, F.lit(None).cast("double").alias("own"), r6(F.col("vector")[1], "mean"))
    return mine.unionByName(theirs)


_WALK_SQL = f"""WITH {_GRAPH_SQL}, t AS (SELECT a, b, count(*)::BIGINT AS times FROM adj GROUP BY a, b),
 c AS (SELECT a, b, times, sum(times) OVER (PARTITION BY a ORDER BY b)::BIGINT AS high, sum(times) OVER (PARTITION BY a)::BIGINT AS degree FROM t),
 w0 AS (SELECT p_partkey AS walk_id, 0 AS step, 'movie/' || p_partkey AS node FROM part)""" + "".join(
    f""", w{step} AS (SELECT w.walk_id, {step} AS step, c.b AS node FROM w{step - 1} w
   JOIN c ON c.a = w.node AND ('0x' || substr(md5('3_{step}_' || walk_id), 1, 15))::BIGINT % c.degree >= c.high - c.times AND ('0x' || substr(md5('3_{step}_' || walk_id), 1, 15))::BIGINT % c.degree < c.high)"""
    for step in (1, 2, 3)
) + " SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3"


def _walk(spark: SparkSession, folder: str, **how) -> DataFrame:
    starts = catalog(spark, folder).select(F.col("pos").alias("walk_id"), F.concat(F.lit("movie\u001f"), F.col("item_id")).alias("node"))
    return graph.random_walk(_edges(spark, folder), starts, 3, **how).select("walk_id", "step", F.translate("node", "\u001f", "/").alias("node"))


@query("graph_random_walk", _WALK_SQL)
def graph_random_walk(spark: SparkSession, folder: str) -> DataFrame:
    return _walk(spark, folder)


@query("graph_random_walk_ranges", _WALK_SQL)
def graph_random_walk_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same walks with hubs of more than 300 edges laid out in ranges."""
    return _walk(spark, folder, hot_rows=300)


# Two layers: three features to four numbers, and those to four. Fixed numbers, so that SQL can say the same.
_LAYERS = [
    [[0.9, -0.4, 0.2, 0.7, 0.3, -0.2], [-0.5, 0.8, 0.1, -0.3, 0.9, 0.4], [0.3, 0.6, -0.7, 0.8, -0.5, 0.6], [-0.2, 0.5, 0.6, 0.4, 0.2, -0.9]],
    [[0.7, -0.3, 0.5, 0.2, 0.4, -0.6, 0.1, 0.8], [-0.4, 0.9, 0.2, -0.5, 0.6, 0.3, -0.7, 0.1], [0.2, 0.4, -0.8, 0.6, -0.3, 0.5, 0.9, -0.2], [0.5, -0.2, 0.3, 0.9, -0.1, 0.7, -0.4, 0.6]],
]


def _layer_sql(weights: list[list[float]], source: str, target: str, out: str) -> str:
    width = len(weights[0]) // 2
    means = ", ".join(f"avg(f.v{i}) AS m{i}" for i in range(width))
    lines = [
        " + ".join([f"{w}::DOUBLE * f.v{i}" for i, w in enumerate(row[:width])] + [f"{w}::DOUBLE * coalesce(m.m{i}, 0.0)" for i, w in enumerate(row[width:])])
        for row in weights
    ]
    values = ", ".join(f"{out.format(line)} AS v{j}" for j, line in enumerate(lines))
    return f"{target}_m AS (SELECT a AS node, {means} FROM adj JOIN {source} f ON f.node = adj.b GROUP BY a), {target} AS (SELECT f.node, {values} FROM {source} f LEFT JOIN {target}_m m USING (node))"


@query(
    "graph_embedding_search",
    f"""WITH {_GRAPH_SQL}, vertices AS (SELECT a AS node FROM adj GROUP BY a),
      f0 AS (SELECT node, coalesce(p_size / 50.0::DOUBLE, 0.5::DOUBLE) AS v0, coalesce(p_retailprice / 2000.0::DOUBLE, 0.25::DOUBLE) AS v1, CASE WHEN p_partkey IS NULL THEN 1.0::DOUBLE ELSE (p_partkey % 97) / 97.0::DOUBLE END AS v2
        FROM vertices LEFT JOIN part ON node = 'movie/' || p_partkey),
      {_layer_sql(_LAYERS[0], "f0", "f1", "greatest({}, 0.0)")}, {_layer_sql(_LAYERS[1], "f1", "f2", "({})")},
      u AS (SELECT node, sqrt(v0 * v0 + v1 * v1 + v2 * v2 + v3 * v3) AS n, v0, v1, v2, v3 FROM f2),
      p AS (SELECT substr(q.node, 13) AS query_id, CAST(substr(c.node, 7) AS BIGINT) AS pos, (q.v0 * c.v0 + q.v1 * c.v1 + q.v2 * c.v2 + q.v3 * c.v3) / (q.n * c.n) AS score FROM u q JOIN u c ON q.node LIKE 'movie_title/%' AND c.node LIKE 'movie/%')
      SELECT query_id, pos, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos) AS rank FROM p) WHERE rank <= 10""",
)
def graph_embedding_search(spark: SparkSession, folder: str) -> DataFrame:
    """Size, price and number of a part as its features; every other vertex has the same fixed ones."""
    edges, items = _edges(spark, folder), catalog(spark, folder)
    own = items.select(
        F.concat(F.lit("movie\u001f"), F.col("item_id")).alias("node"),
        F.array(F.col("size") / 50.0, F.col("price") / 2000.0, (F.col("pos") % 97) / 97.0).alias("vector"),
    )
    vertices = graph.catalog_vertices(edges).select(F.concat_ws("\u001f", "type", "id").alias("node"))
    others = F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0))
    features = vertices.join(own, "node", "left").select("node", F.coalesce("vector", others).alias("vector"))
    embeddings = graph.graph_embeddings(edges, features, [graph.GraphLayer(w) for w in _LAYERS])
    titles = items.select(F.col("title").alias("query_id"), F.lit("movie_title").alias("type"), F.col("title").alias("id")).distinct()
    return graph.embedding_search(embeddings, titles, 10).select("query_id", "pos", r6("score", "score"), "rank")


# Channels for blending: the score and the discount of an order line are two channels of one list.
_CHANNELS_SQL = f"""{SLATES_SQL}, ch AS (SELECT query_id, item_id, pos, 'price' AS channel, score, 0.7::DOUBLE AS weight FROM slates
  UNION ALL SELECT query_id, item_id, pos + 1000, 'discount', discount, 0.3::DOUBLE FROM slates WHERE label = 1),
 st AS (SELECT query_id, channel, min(score) AS lo, max(score) AS hi, avg(score) AS mu, stddev_pop(score) AS sd FROM ch GROUP BY query_id, channel),
 nm AS (SELECT ch.*, CASE WHEN abs(lo - hi) <= greatest(abs(lo), abs(hi)) * 1e-9 THEN 0.0 ELSE (score - lo) / (hi - lo) END AS minmax,
   CASE WHEN sd < 1e-12 THEN 0.0 ELSE (score - mu) / sd END AS zscore, 1.0 / (1.0 + exp(-score)) AS sigmoid FROM ch JOIN st USING (query_id, channel))"""


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = slates(spark, folder)
    price = rows.select("query_id", "item_id", "pos", F.lit("price").alias("channel"), "score", F.lit(0.7).alias("weight"))
    rebate = rows.filter(F.col("label") == 1).select(
        "query_id", "item_id", (F.col("pos") + 1000).alias("pos"), F.lit("discount").alias("channel"), F.col("discount").alias("score"), F.lit(0.3).alias("weight")
    )
    return price.unionByName(rebate)


@query(
    "score_normalization",
    f"""WITH {_CHANNELS_SQL} SELECT query_id, channel, pos, unnest(['minmax', 'zscore', 'sigmoid', 'none']) AS method,
      round(unnest([minmax, zscore, sigmoid, score]), 6) AS norm_score FROM nm""",
)
def score_normalization(spark: SparkSession, folder: str) -> DataFrame:
    """Every row once per method; repeating all rows of a channel leaves its statistics as they are."""
    methods = F.array(*[F.lit(m) for m in blending.METHODS])
    rows = _channels(spark, folder).withColumn("method", F.explode(methods))
    done = blending.normalize_scores(rows, method_col="method")
    return done.select("query_id", "channel", "pos", "method", r6("norm_score", "norm_score"))


@query(
    "blend_channels_top_k",
    f"""WITH {_CHANNELS_SQL}, per AS (SELECT query_id, item_id, channel, sum(minmax * weight) AS w, min(pos) AS pos, count(*) AS n FROM nm GROUP BY query_id, item_id, channel),
      bl AS (SELECT query_id, item_id, sum(w) AS score, CASE WHEN sum(n) = 1 THEN min(channel) ELSE 'blend' END AS source, min(pos) AS pos,
        coalesce(max(CASE WHEN channel = 'price' THEN w END), 0.0) AS price, coalesce(max(CASE WHEN channel = 'discount' THEN w END), 0.0) AS discount FROM per GROUP BY query_id, item_id)
      SELECT query_id, item_id, round(score, 6) AS score, source, round(price, 6) AS price, round(discount, 6) AS discount, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos, item_id) AS rank FROM bl) WHERE rank <= 3""",
)
def blend_channels_top_k(spark: SparkSession, folder: str) -> DataFrame:
    blended = blending.blend_channels(blending.normalize_scores(_channels(spark, folder), "minmax"))
    top = blending.blend_top_k(blended.withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9)), 3)
    part = lambda c: r6(F.coalesce(F.col("sources")[c], F.lit(0.0)), c)
    return top.select("query_id", "item_id", r6("exact", "score"), "source", part("price"), part("discount"), "rank")


@query(
    "merge_best_candidates",
    f"""WITH {_CHANNELS_SQL} SELECT query_id, item_id, channel, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY score DESC, pos) AS n FROM ch) WHERE n = 1""",
)
def merge_best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return blending.merge_best(_channels(spark, folder)).select("query_id", "item_id", "channel", r6("score", "score"))
