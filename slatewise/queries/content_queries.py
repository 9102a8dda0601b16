"""Catalogue, text, entity, quality, contract, feature and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators import contracts, entities, eventlog, features, quality, screening, search
from slatewise.operators.scale import numbered
from slatewise.queries.inputs import catalog, events, r6, table
from slatewise.queries.registry import query
from slatewise.sources import catalog as cat
from slatewise.sources import facts, ingestion


# --- catalogue -------------------------------------------------------------------------------------------------------


@query("load_catalog", "SELECT p_partkey AS pos, lower(p_name) AS movie_title, coalesce(CASE WHEN p_size > 25 THEN p_type END, '') AS comb FROM part")
def load_catalog(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("movie_title"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("comb"))
    return cat.load_catalog(raw)


@query("stable_item_id", "SELECT p_partkey AS pos, sha256('movies|' || lower(p_name)) AS item_id FROM part")
def stable_item_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), X.stable_item_id(F.lit("movies"), F.lower("p_name")).alias("item_id"))


def _flat(items: DataFrame, *text: str) -> DataFrame:
    fields = [F.col(f"modalities.text.{t}").alias(t) for t in text]
    return items.select(F.col("provenance.row_index").cast("long").alias("pos"), "item_id", "domain", "locale", *fields)


@query(
    "normalize_movies",
    "SELECT p_partkey AS pos, sha256('movies|' || lower(p_name)) AS item_id, 'movies' AS domain, 'en' AS locale, p_name AS title, p_type || ' ' || p_brand AS combined FROM part",
)
def normalize_movies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("movie_title"), F.concat_ws(" ", "p_type", "p_brand").alias("comb"))
    return _flat(cat.movies(rows, cat.AdapterConfig("movies_catalog", "movies")), "title", "combined")


@query(
    "normalize_rated_films",
    """SELECT p_partkey AS pos, sha256('movies|movielens:' || p_partkey) AS item_id, 'movies' AS domain, 'en' AS locale, p_name AS title, trim(p_name || ' ' || CASE WHEN p_size > 10 THEN p_type || '|' || p_brand ELSE '' END) AS combined,
      CASE WHEN p_size > 10 THEN p_type || '|' || p_brand ELSE '' END AS genres FROM part""",
)
def normalize_rated_films(spark: SparkSession, folder: str) -> DataFrame:
    genres = F.when(F.col("p_size") > 10, F.concat_ws("|", "p_type", "p_brand"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), genres.alias("genres"))
    return _flat(cat.rated_films(rows, cat.AdapterConfig("movielens_movies", "movies")), "title", "combined", "genres")


@query(
    "normalize_mapped_table",
    """SELECT s_suppkey AS pos, sha256('shops|' || s_suppkey) AS item_id, 'shops' AS domain, 'de' AS locale, s_name AS title, s_name || ' ' || n_name || ' ' || r_name AS combined
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def normalize_mapped_table(spark: SparkSession, folder: str) -> DataFrame:
    # nation and region are fixed reference tables of 25 and 5 rows.
    nations = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("row_index", F.col("s_suppkey"))
    config = cat.AdapterConfig("mapped_tabular", "shops", "de", id_column="s_suppkey", title_column="s_name", text_columns=("n_name", "r_name"))
    return _flat(cat.mapped_table(rows, config), "title", "combined")


@query(
    "normalize_products",
    """SELECT p_partkey AS pos, sha256('shop|' || CASE WHEN p_size % 2 = 0 THEN p_brand || p_partkey ELSE 'a' || p_partkey END) AS item_id, p_name AS title,
      p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE '' END AS combined,
      'http://x.org/' || p_partkey || '.png|image/png,http://x.org/' || p_partkey || '.bin|application/octet-stream' AS images FROM part""",
)
def normalize_products(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    url = lambda end: F.concat(F.lit("http://x.org/"), F.col("p_partkey").cast("string"), F.lit(end))
    image = F.struct(url(".png").alias("hi_res"), F.lit(None).cast("string").alias("large"), F.lit("").alias("thumb"), url(".bin").alias("medium"), F.lit(None).cast("string").alias("small"))
    rows = parts.select(
        F.col("p_partkey").alias("row_index"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.col("p_partkey").cast("string"))).otherwise("nan").alias("parent_asin"),
        F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("asin"),
        F.col("p_name").alias("title"),
        F.array(F.lit(" "), F.col("p_type"), F.lit(None).cast("string")).alias("features"),
        F.when(F.col("p_size") > 25, F.array("p_brand")).alias("description"),
        F.array().cast("array<string>").alias("categories"),
        F.array(image).alias("images"),
        F.create_map().cast("map<string,string>").alias("details"),
        F.lit(None).cast("string").alias("store"),
    )
    items = cat.products(rows, cat.AdapterConfig("amazon_reviews_2023_meta", "shop"))
    shown = F.array_join(F.transform("assets.image", lambda a: F.concat_ws("|", a["uri"], a["mime_type"])), ",")
    return items.select(F.col("provenance.row_index").cast("long").alias("pos"), "item_id", F.col("modalities.text.title").alias("title"), F.col("modalities.text.combined").alias("combined"), shown.alias("images"))


@query(
    "normalize_music",
    """SELECT p_partkey AS pos, sha256('music|' || lower(p_name)) AS item_id, 'music' AS domain, 'en' AS locale, p_name AS title, p_type || ',' || p_brand AS genres, p_brand AS aliases FROM part""",
)
def normalize_music(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    none = F.lit(None).cast("string")
    rows = parts.select(
        F.col("p_partkey").alias("row_index"), F.concat(F.lit(" "), "p_name").alias("artist_name"), none.alias("entity_type"), none.alias("country"),
        F.concat("p_type", F.lit("| "), "p_brand", F.lit(" |")).alias("genres"), none.alias("born"), none.alias("disambiguation"), F.concat(F.lit("||"), "p_brand").alias("aliases"), none.alias("comb"),
    )
    items = _flat(cat.music(rows, cat.AdapterConfig("music_catalog", "music")), "title", "genres", "aliases")
    return items.withColumn("genres", F.array_join("genres", ",")).withColumn("aliases", F.array_join("aliases", ","))


@query(
    "normalize_books",
    "SELECT p_partkey AS pos, sha256('books|' || lower(p_name)) AS item_id, 'books' AS domain, 'en' AS locale, p_name AS title, p_brand AS authors, p_type || ';' || p_brand AS subjects, CAST(p_size AS VARCHAR) AS first_publish_year FROM part",
)
def normalize_books(spark: SparkSession, folder: str) -> DataFrame:
    parts, none = table(spark, folder, "part"), F.lit(None).cast("string")
    rows = parts.select(
        F.col("p_partkey").alias("row_index"), F.col("p_name").alias("book_title"), F.concat("p_brand", F.lit("|")).alias("authors"), F.col("p_size").cast("string").alias("first_publish_year"),
        F.concat_ws("|", "p_type", "p_brand").alias("subjects"), none.alias("cover_id"), none.alias("key"), none.alias("comb"),
    )
    items = _flat(cat.books(rows, cat.AdapterConfig("books_catalog", "books")), "title", "authors", "subjects", "first_publish_year")
    return items.withColumn("authors", F.array_join("authors", ",")).withColumn("subjects", F.array_join("subjects", ";"))


@query(
    "media_types",
    r"""SELECT page_id, CASE lower(regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]+://[^/?#]*)?([^?#]*)', 1), '[^/]\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html'
      WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type FROM pages""",
)
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", X.media_type("url").alias("mime_type"))


@query(
    "facts_lines",
    "SELECT p_partkey AS pos, 'Truth File: Name: ' || p_name || CASE WHEN p_size > 20 THEN ' | Type: ' || p_type ELSE '' END || ' | Size: ' || p_size AS facts, 'type' IN (SELECT 'type' WHERE p_size > 20) AS has_type, p_name AS name FROM part",
)
def facts_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line out of columns, and the map read back from it."""
    parts = table(spark, folder, "part")
    line = X.facts_line([("Name", F.col("p_name")), ("Type", F.when(F.col("p_size") > 20, F.col("p_type"))), ("Size", F.col("p_size"))])
    lined = parts.select(F.col("p_partkey").alias("pos"), line.alias("facts")).withColumn("m", X.facts_map(F.concat(F.lit("intro\n"), F.col("facts"))))
    return lined.select("pos", "facts", F.map_contains_key("m", F.lit("type")).alias("has_type"), F.col("m")["name"].alias("name"))


@query(
    "artist_facts",
    """SELECT p_partkey AS pos, 'Truth File: Artist: ' || p_name || ' | Type: ' || p_type || ' | Genres: ' || CASE WHEN p_size >= 10 THEN p_type || ', ' || p_brand ELSE p_brand || ', ' || p_type END AS facts, p_brand AS aliases FROM part WHERE p_retailprice >= 950""",
)
def artist_facts(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    tag = lambda name, count: F.struct(name.alias("name"), count.cast("long").alias("count"))
    payload = F.struct(
        F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_retailprice") - 900.0).alias("score"),
        F.array(tag(F.col("p_brand"), F.lit(10)), tag(F.col("p_type"), F.col("p_size") + 1), tag(F.lit("bad"), F.lit(-1))).alias("tags"),
        F.array(F.struct(F.lit("").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("aliases"),
    )
    rows = parts.select(F.col("p_partkey").alias("pos"), F.to_json(payload).alias("payload"))
    return facts.artist_facts(rows).select("pos", "facts", F.array_join("aliases", ",").alias("aliases"))


@query(
    "book_facts",
    """SELECT p_partkey AS pos, 'Truth File: Book: ' || p_name || ' | Author: ' || p_brand || ' | Published: ' || (p_size + 1900) || ' | Subjects: ' || p_type AS facts, p_type AS subjects FROM part""",
)
def book_facts(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    payload = F.struct(
        F.col("p_name").alias("title"), F.array("p_brand").alias("author_name"), (F.col("p_size") + 1900).alias("first_publish_year"),
        F.array(F.lit("nyt:list"), F.col("p_type"), F.lit("")).alias("subject"),
    )
    rows = parts.select(F.col("p_partkey").alias("pos"), F.to_json(payload).alias("payload"))
    return facts.book_facts(rows).select("pos", "facts", F.array_join("subjects", ",").alias("subjects"))


@query(
    "film_facts",
    """SELECT p_partkey AS pos, CASE WHEN p_size > 10 THEN p_brand ELSE 'Unknown' END AS director, CASE WHEN p_size > 10 THEN p_type || ', ' || p_name ELSE '' END AS actors,
      CASE WHEN p_size > 10 THEN 'Truth File: Movie: ' || p_name || ' | Director: ' || p_brand || ' | Cast: ' || p_type || ', ' || p_name || ' | Release: 1999 | Overview: ' END AS facts FROM part""",
)
def film_facts(spark: SparkSession, folder: str) -> DataFrame:
    person = lambda name, job=None: F.struct(name.alias("name"), *([F.lit(job).alias("job")] if job else []))
    payload = F.struct(
        F.col("p_name").alias("title"), F.array(person(F.col("p_type"), "Writer"), person(F.col("p_brand"), "Director"), person(F.col("p_name"), "Director")).alias("crew"),
        F.array(person(F.col("p_type")), person(F.col("p_name"))).alias("cast"), F.lit("1999").alias("release_date"),
    )
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.to_json(payload)).alias("payload"))
    return facts.film_facts(rows).select("pos", "director", F.col("cast").alias("actors"), "facts")


@query(
    "zipped_lists",
    """SELECT p_partkey AS pos, p_name || '=' || CASE WHEN p_size > 10 THEN p_size ELSE p_size + 1 END || ';' || CASE WHEN p_size > 10 THEN p_brand || '=' || (p_size + 1) ELSE '' END AS entries FROM part""",
)
def zipped_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Names as JSON list, numbers as loosely quoted text; a repeated name keeps its last number."""
    parts = table(spark, folder, "part")
    second = F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.col("p_name"))
    names = F.to_json(F.array("p_name", second, F.lit("left over")))
    numbers = F.concat(F.lit('["'), F.col("p_size").cast("string"), F.lit('","'), (F.col("p_size") + 1).cast("string"), F.lit('"]'))
    rows = parts.select(F.col("p_partkey").alias("pos"), names.alias("name"), numbers.alias("number"))
    zipped = facts.zip_lists(rows, ["name", "number"])
    joined = F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["name"], e["number"])), ";")
    return zipped.select("pos", F.when(F.size("entries") == 1, F.concat(joined, F.lit(";"))).otherwise(joined).alias("entries"))


@query(
    "rank_decayed_candidates",
    """WITH r AS (SELECT p_partkey AS pos, p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)
      SELECT pos, round(greatest(0.1, 1 - k * 0.15), 6) AS score, round(0.7 * greatest(0.1, 1 - k * 0.15), 6) AS text, round(0.2 * greatest(0.1, 1 - k * 0.15), 6) AS popularity, sha256('music|' || lower(p_name)) AS item_id FROM r""",
)
def rank_decayed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    ranked = numbered(table(spark, folder, "part"), ["p_type"], ["p_partkey"], "rank").withColumn("rank", F.col("rank") - 1)
    done = facts.fact_candidates(ranked, "music", "p_name")
    return done.select(F.col("p_partkey").alias("pos"), r6("score", "score"), r6("text", "text"), r6("popularity", "popularity"), "item_id")


@query(
    "distinct_items",
    "SELECT l_partkey AS item_id, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
)
def distinct_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("item_id", F.col("l_partkey"))
    kept = ingestion.deduplicate_domain(rows, [F.col("l_shipdate").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]], stamp=False)
    return kept.select("item_id", "l_orderkey", "l_linenumber")


_RECORD_LIMIT_SQL = "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n <= 1000"


def _limited(spark: SparkSession, folder: str, **how) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ordered = numbered(lines, [], lines.columns, "row_index", **how)
    return ingestion.limit_records(ordered.withColumn("row_index", F.col("row_index") - 1), 1000).select("l_orderkey", "l_partkey")


@query("record_limit", _RECORD_LIMIT_SQL)
def record_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _limited(spark, folder)


@query("record_limit_ranges", _RECORD_LIMIT_SQL)
def record_limit_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbers over ranges of at most 20,000 lines or so."""
    return _limited(spark, folder, hot_rows=20_000)


@query(
    "snapshot_registry",
    """WITH r AS (SELECT DISTINCT p_brand || ':' || p_size || '/' || CAST(floor(p_retailprice / 100) AS BIGINT) AS k FROM part WHERE p_type = 'PROMO'), b AS (SELECT p_brand || ':' || p_size || '/' || CAST(floor(p_retailprice / 100) AS BIGINT) AS k, count(*) AS n FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
      SELECT k AS snapshot_key, CASE WHEN n > 1 OR k IN (SELECT k FROM r) THEN 'clash' ELSE 'append' END AS outcome FROM b""",
)
def snapshot_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One part type is the registry, all others are the batch."""
    version = F.concat_ws("/", F.col("p_size").cast("string"), F.floor(F.col("p_retailprice") / 100).cast("string"))
    keyed = table(spark, folder, "part").select(F.col("p_brand").alias("dataset_id"), version.alias("version"), "p_type")
    fresh, clashing = ingestion.register_snapshots(keyed.filter("p_type = 'PROMO'"), keyed.filter("p_type <> 'PROMO'"))
    added = fresh.select(ingestion.snapshot_key().alias("snapshot_key"), F.lit("append").alias("outcome"))
    return added.unionByName(clashing.select("snapshot_key", F.lit("clash").alias("outcome")))


# --- lookup ----------------------------------------------------------------------------------------------------------


@query(
    "title_search",
    """WITH q AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part UNION SELECT DISTINCT substr(p_name, 1, 2) FROM part),
      m AS (SELECT q.t AS query_id, p_partkey AS pos, lower(p_name) = lower(q.t) AS exact, max(CASE WHEN lower(p_name) = lower(q.t) THEN 1 ELSE 0 END) OVER (PARTITION BY q.t) AS any_exact
        FROM q JOIN part ON contains(lower(p_name), lower(q.t)))
      SELECT query_id, pos, exact FROM m WHERE exact OR any_exact = 0""",
)
def title_search(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog(spark, folder)
    texts = items.select(F.col("title").alias("t")).union(items.select(F.split("title", " ")[1])).union(items.select(F.substring("title", 1, 2))).distinct()
    found = search.search_titles(texts.select(F.col("t").alias("query_id"), F.col("t").alias("query_text")), items)
    return found.select("query_id", "pos", "exact")


@query("distinct_names", "SELECT DISTINCT unnest([p_type, p_brand]) AS name FROM part")
def distinct_names(spark: SparkSession, folder: str) -> DataFrame:
    return search.distinct_names(table(spark, folder, "part").select(F.concat("p_type", F.lit(" | |"), "p_brand").alias("authors")), "authors")


@query("display_titles", "SELECT p_partkey AS pos, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capitalized, array_to_string([upper(substr(w, 1, 1)) || substr(w, 2) for w in string_split(p_name, ' ')], ' ') AS title_case FROM part")
def display_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), search.capitalized(F.col("p_type")).alias("capitalized"), F.initcap("p_name").alias("title_case"))


@query(
    "titles_of_items",
    "WITH i AS (SELECT DISTINCT CAST(l_partkey * 2 AS VARCHAR) AS item_id FROM lineitem UNION SELECT p_name FROM part UNION SELECT p_brand FROM part) SELECT item_id, coalesce(p.p_name, n.p_name) AS title FROM i LEFT JOIN part p ON CAST(p_partkey AS VARCHAR) = item_id LEFT JOIN (SELECT DISTINCT p_name FROM part) n ON n.p_name = item_id",
)
def titles_of_items(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog(spark, folder)
    ids = table(spark, folder, "lineitem").select((F.col("l_partkey") * 2).cast("string").alias("item_id"))
    ids = ids.union(items.select("title")).union(items.select("provider")).distinct()
    return search.titles_of_items(ids, items)


@query(
    "longest_mention",
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS name, item_id FROM benchmark), n AS (SELECT name, min(item_id) AS pos FROM w GROUP BY name),
      t AS (SELECT page_id AS text_id, replace(replace(lower(html), ' ', ''), '.', '') AS body FROM pages)
      SELECT text_id, name, pos FROM (SELECT text_id, name, pos, row_number() OVER (PARTITION BY text_id ORDER BY length(name) DESC, pos, name) AS k FROM t JOIN n ON contains(body, name)) WHERE k = 1""",
)
def longest_mention(spark: SparkSession, folder: str) -> DataFrame:
    """Names: every word of four or more letters in the benchmark texts; bodies: whole pages."""
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("name"), F.col("item_id").alias("pos"))
    names = words.groupBy("name").agg(F.min("pos").alias("pos"))
    texts = table(spark, folder, "pages").select(F.col("page_id").alias("text_id"), F.translate(F.lower("html"), " .", "").alias("text"))
    return search.longest_mention(texts, names, fold=False)


_FOLD_SQL = r"replace(replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), ' ', ''), '.', '')"


@query(
    "longest_mention_folded",
    f"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS name, item_id FROM benchmark), n AS (SELECT name, min(item_id) AS pos, any_value({_FOLD_SQL.format('name')}) AS needle FROM w WHERE length(name) >= 6 GROUP BY name),
      t AS (SELECT doc_id AS text_id, {_FOLD_SQL.format('text')} AS body FROM documents)
      SELECT text_id, name, pos FROM (SELECT text_id, name, pos, row_number() OVER (PARTITION BY text_id ORDER BY length(name) DESC, pos, name) AS k FROM t JOIN n ON needle <> '' AND contains(body, needle)) WHERE k = 1""",
)
def longest_mention_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Names: every word of six or more characters in the benchmark texts; bodies: whole documents, both without accents."""
    words = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("name"), F.col("item_id").alias("pos"))
    names = words.filter(F.length("name") >= 6).groupBy("name").agg(F.min("pos").alias("pos"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return search.longest_mention(texts, names)


@query(
    "mentioned_entities",
    """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), q AS (SELECT p.*, list_distinct(regexp_extract_all(lower(s_name || ' small ' || n_name || ' bolt'), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS n
      FROM p JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey)
      SELECT l_suppkey AS query_id, l_partkey AS pos, len(list_intersect(q, n)) >= greatest(1, len(n) * 0.5) AS mentioned FROM q""",
)
def mentioned_entities(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    # nation is a fixed reference table of 25 rows.
    shops = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    asked = shops.select(F.col("s_suppkey").alias("l_suppkey"), F.concat_ws(" ", "s_name", F.lit("small"), "n_name", F.lit("bolt")).alias("q"))
    joined = pairs.join(asked, "l_suppkey").join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return joined.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("pos"), screening.mentions_entity(F.col("q"), F.col("p_name")).alias("mentioned"))


# --- entities --------------------------------------------------------------------------------------------------------

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')"""
_ENTITY_SQL = f"""nn AS (SELECT doc_id, {_NORMAL} AS name FROM documents), tk AS (SELECT doc_id, name, list_filter(string_split(name, ' '), lambda x: x <> '') AS w FROM nn),
 bl AS (SELECT doc_id, name, coalesce(substr(w[1], 1, 3), 'unknown') AS block, list_sort(list_distinct(w)) AS s FROM tk), cl AS (SELECT block, s, min(doc_id) AS pos FROM bl GROUP BY block, s),
 pr AS (SELECT a.block, a.pos AS pos_i, b.pos AS pos_j, len(list_intersect(a.s, b.s))::DOUBLE AS i, len(a.s) AS x, len(b.s) AS y FROM cl a JOIN cl b ON a.block = b.block AND a.pos < b.pos)"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("pos"), F.col("text").alias("name"))


@query("entity_names", f"WITH {_ENTITY_SQL} SELECT doc_id, md5(name) AS name_md5, block FROM bl")
def entity_names(spark: SparkSession, folder: str) -> DataFrame:
    name = entities.normal_name("text")
    return table(spark, folder, "documents").select("doc_id", F.md5(name).alias("name_md5"), entities.blocking_key(name).alias("block"))


@query("entity_match_pairs", f"WITH {_ENTITY_SQL} SELECT block, pos_i, pos_j, round(i / (x + y - i), 6) AS score FROM pr WHERE i / (x + y - i) >= 0.5")
def entity_match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    _, pairs = entities.match_pairs(_records(spark, folder), 0.5)
    return pairs.select("block", "pos_i", "pos_j", r6("score", "score"))


@query("entity_resolution")
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return entities.canonical_lookup(records.select("record_id"), entities.resolve_entities(records, 0.8))


_MERGE_SQL = """m AS (SELECT p_partkey AS pos, 'shop_' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || CASE WHEN p_size % 2 = 0 THEN '_' || (p_size % 5) ELSE '' END AS canonical_id, p_brand, CASE WHEN p_size > 30 THEN p_type ELSE '' END AS kind FROM part)"""


def _merge_input(spark: SparkSession, folder: str) -> DataFrame:
    year = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") % 5).cast("string"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), year.alias("year"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") > 30, F.col("p_type")).otherwise("").alias("kind"),
    )


@query("merged_entities", f"WITH {_MERGE_SQL} SELECT canonical_id, count(*) AS sources, arg_min(p_brand, pos) AS brand, arg_min(kind, pos) FILTER (kind <> '') AS kind FROM m GROUP BY canonical_id")
def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    return entities.merge_by_key(_merge_input(spark, folder), "shop", ["brand", "kind"]).select("canonical_id", "sources", "brand", "kind")


@query("merge_provenance", f"WITH {_MERGE_SQL} SELECT canonical_id, pos, 'unknown' AS source_id, CAST(pos AS VARCHAR) AS original_id FROM m")
def merge_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return entities.merge_provenance(_merge_input(spark, folder), "shop").select("canonical_id", "pos", "source_id", "original_id")


# --- quality and contracts -------------------------------------------------------------------------------------------


def _profile_sql(source: str, columns: dict[str, bool]) -> str:
    parts = [f"SELECT '*' AS column, 'row_count' AS metric, count(*)::DOUBLE AS value FROM {source}"]
    for name, number in columns.items():
        parts.append(f"SELECT '{name}', 'missing_fraction', round(avg(({name} IS NULL)::INT), 6) FROM {source}")
        parts.append(f"SELECT '{name}', 'unique_count', count(DISTINCT {name})::DOUBLE FROM {source}")
        if number:
            for metric, function in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
                parts.append(f"SELECT '{name}', '{metric}', round({function}({name})::DOUBLE, 6) FROM {source}")
    return " UNION ALL ".join(parts)


_SIDES_SQL = """a AS (SELECT l_quantity AS qty, sqrt(l_discount) AS discount, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END AS tax, l_linestatus AS status FROM lineitem WHERE l_returnflag = 'R'),
 b AS (SELECT l_quantity * 2 AS qty, sqrt(l_discount) AS discount, CASE WHEN l_tax > 0.01 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS status FROM lineitem WHERE l_returnflag <> 'R')"""
_WHOLE_SQL = "a AS (SELECT l_quantity AS qty, sqrt(l_discount) AS discount, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END AS tax, l_linestatus AS status FROM lineitem)"
_SIDE_COLUMNS = {"qty": True, "discount": True, "tax": True, "status": False}


def _profiled(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_quantity").alias("qty"), F.sqrt("l_discount").alias("discount"), F.when(F.col("l_tax") <= 0.06, F.col("l_tax")).alias("tax"), F.col("l_linestatus").alias("status"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    base = _profiled(lines.filter(returned))
    now = lines.filter(~returned).select(
        (F.col("l_quantity") * 2).alias("qty"), F.sqrt("l_discount").alias("discount"), F.when(F.col("l_tax") <= 0.01, F.col("l_tax")).alias("tax"), F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")).alias("status")
    )
    return base, now


@query("column_profile", f"WITH {_WHOLE_SQL} {_profile_sql('a', _SIDE_COLUMNS)}")
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """All lines."""
    return quality.profile(_profiled(table(spark, folder, "lineitem"))).select("column", "metric", r6("value", "value"))


@query(
    "profile_drift",
    f"""WITH {_SIDES_SQL}, pa AS ({_profile_sql('a', _SIDE_COLUMNS)}), pb AS ({_profile_sql('b', _SIDE_COLUMNS)}), j AS (SELECT x."column" AS "column", x.metric AS metric, x.value AS b, y.value AS c FROM pa x JOIN pb y ON x."column" = y."column" AND x.metric = y.metric)
      SELECT "column", 'missing_fraction' AS metric, b AS baseline, c AS current, 0.05 AS threshold FROM j WHERE metric = 'missing_fraction' AND abs(c - b) > 0.05
      UNION ALL SELECT "column", 'unique_count_ratio', b, c, 0.3 FROM j WHERE metric = 'unique_count' AND b > 0 AND abs(c - b) / b > 0.3
      UNION ALL SELECT "column", 'mean_delta', b, c, 0.25 FROM j WHERE metric = 'mean' AND abs(c - b) > 0.25
      UNION ALL SELECT "column", 'std_ratio', b, c, 0.5 FROM j WHERE metric = 'std' AND b > 0 AND abs(c - b) / b > 0.5""",
)
def profile_drift(spark: SparkSession, folder: str) -> DataFrame:
    base, now = _sides(spark, folder)
    found = quality.compare_profiles(quality.profile(base), quality.profile(now))
    return found.select("column", "metric", r6("baseline", "baseline"), r6("current", "current"), "threshold")


_LEAK_SQL = "l AS (SELECT l_extendedprice AS price, l_quantity AS label, l_quantity * 2 + l_discount AS leak, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax, l_quantity / nullif(l_linenumber - 1, 0) AS part FROM lineitem)"


def _leaky(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("label"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("leak"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / (F.col("l_linenumber") - 1)).alias("part"),
    )


@query("leakage_correlation", f"WITH {_LEAK_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(abs(corr({c}, label)), 6) AS correlation, abs(corr({c}, label)) >= 0.95 AS leaked FROM l" for c in ("price", "leak", "tax", "part")))
def leakage_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.correlation_leakage(_leaky(spark, folder)).select("column", r6("correlation", "correlation"), "leaked")


@query("leakage_forest")
def leakage_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _leaky(spark, folder).withColumn("label", (F.col("label") > 25).cast("int"))
    return quality.forest_leakage(rows).select("column", r6("importance", "importance"), "leaked")


@query(
    "event_contract",
    """SELECT event_id, event_type <> 'error' AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS valid,
      concat_ws('; ', CASE WHEN event_type = 'error' THEN 'event_type: missing' END, CASE WHEN event_id % 5 = 0 THEN 'user_id: not string' END, CASE WHEN event_id % 11 = 0 THEN 'occurred_at_utc: missing' END, CASE WHEN event_id % 7 = 0 THEN 'properties: not object' END) AS violations FROM events""",
)
def event_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows written as JSON records, some of them broken on purpose: every row is checked."""
    e = table(spark, folder, "events")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda c: F.regexp_extract(quoted(c.cast("string")), r'^\{"v":(.*)\}$', 1)
    record = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            field("event_id", text(F.col("event_id"))),
            F.when(F.col("event_type") != "error", field("event_type", text(F.col("event_type")))),
            field("user_id", F.when(F.col("event_id") % 5 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(text(F.col("user_id")))),
            F.when(F.col("event_id") % 11 != 0, field("occurred_at_utc", text(F.col("ts")))),
            field("properties", F.when(F.col("event_id") % 7 == 0, text(F.col("props"))).otherwise(F.col("props"))),
        ),
        F.lit("}"),
    )
    checked = contracts.validate_records(e.select("event_id", record.alias("payload")), "event")
    return checked.select("event_id", "valid", F.array_join("violations", "; ").alias("violations"))


@query("item_contract", "SELECT p_partkey AS pos, p_size % 4 <> 0 AS valid, CASE WHEN p_size % 4 = 0 THEN 'assets.image[1].mime_type: missing' ELSE '' END AS violations FROM part")
def item_contract(spark: SparkSession, folder: str) -> DataFrame:
    asset = lambda mime: F.struct(F.col("p_name").alias("uri"), mime.alias("mime_type"))
    images = F.array(asset(F.lit("image/png")), asset(F.when(F.col("p_size") % 4 != 0, F.lit("image/gif"))))
    empty = F.create_map().cast("map<string,string>")
    payload = F.struct(
        F.col("p_name").alias("item_id"), F.lit("shop").alias("domain"), F.lit("en").alias("locale"),
        F.struct(empty.alias("text"), empty.alias("image"), empty.alias("audio"), empty.alias("video"), empty.alias("sequence")).alias("modalities"),
        F.struct(images.alias("image")).alias("assets"), empty.alias("provenance"),
    )
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.to_json(payload).alias("payload"))
    checked = contracts.validate_records(rows, "item")
    return checked.select("pos", "valid", F.array_join("violations", "; ").alias("violations"))


@query("known_event_types", "SELECT event_id, event_type IN ('impression', 'click', 'dwell', 'purchase', 'save', 'hide', 'skip', 'complaint') AS known FROM events")
def known_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", contracts.known_event_type().alias("known"))


# --- features --------------------------------------------------------------------------------------------------------


@query(
    "hash_vectors",
    "WITH h AS (SELECT p_partkey AS pos, sha256(p_name || ' ' || p_type) AS d, unnest(range(48)) AS i FROM part) SELECT pos, i, round(('0x' || substr(d, CAST((i % 32) * 2 + 1 AS BIGINT), 2))::INT / 255.0::DOUBLE, 6) AS v FROM h",
)
def hash_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_type").alias("overview"))
    coded = features.encode_by_hash(rows, features.encoder_input("text"), 48)
    return coded.select("pos", F.posexplode("vector").alias("i", "v")).select("pos", F.col("i").cast("long").alias("i"), r6("v", "v"))


@query("first_tokens", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:12], ' ') AS tokens FROM documents")
def first_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.first_tokens("text", 12), " ").alias("tokens"))


@query(
    "encoder_inputs",
    "SELECT p_partkey AS pos, CASE WHEN p_size > 20 THEN p_name || ' ' || p_type ELSE p_name END AS text_input, CASE WHEN p_size > 30 THEN p_brand || ' ' || p_type ELSE p_name END AS image_input FROM part",
)
def encoder_inputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("overview"),
        F.when(F.col("p_size") > 30, F.array("p_brand", "p_type")).alias("uris"),
    )
    return rows.select("pos", features.encoder_input("text").alias("text_input"), features.encoder_input("image").alias("image_input"))


@query(
    "fitted_vectors",
    "WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(100)) AS i FROM embeddings) SELECT vec_id AS pos, i, round(CASE WHEN label = 3 THEN 0.0 ELSE v[CAST(i % 64 + 1 AS BIGINT)] END, 6) AS v FROM c JOIN embeddings e USING (vec_id)",
)
def fitted_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pos"), F.when(F.col("label") == 3, F.array().cast("array<double>")).otherwise(F.col("embedding").cast("array<double>")).alias("vector")
    )
    return rows.select("pos", F.posexplode(X.fit_vector("vector", 100)).alias("i", "v")).select("pos", F.col("i").cast("long").alias("i"), r6("v", "v"))


@query(
    "fused_modalities",
    """WITH c AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label AS item_id, i, round(avg(v), 6) AS v FROM c WHERE label <> 5 GROUP BY label, i UNION ALL SELECT 5, -1, NULL""",
)
def fused_modalities(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector of a class is one modality of the item; class 5 gets vectors of unequal length."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("item_id"), F.col("vec_id").alias("modality"), F.when(F.col("label") == 5, F.slice(v, F.lit(1), (F.col("vec_id") % 9 + 1).cast("int"))).otherwise(v).alias("vector"))
    fused = features.fuse_modalities(rows)
    return fused.select("item_id", F.posexplode_outer("vector").alias("i", "v")).select("item_id", F.coalesce("i", F.lit(-1)).cast("long").alias("i"), r6("v", "v"))


def _feature_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.lit("default").alias("namespace"), F.lit("item").alias("entity_type"), F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_returnflag").alias("feature_name"), F.lit("v1").alias("feature_version"),
        F.lit("text").alias("modality"), F.array("l_discount", "l_tax").alias("vector"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return lines.select(features.feature_key().alias("key"), "vector", "seq")


_FEATURE_SQL = "f AS (SELECT 'default:item:' || l_partkey || ':' || l_returnflag || ':v1:text' AS key, l_discount AS a, l_tax AS b, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_extendedprice AS p FROM lineitem), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o DESC, n DESC, s DESC, p DESC) AS r FROM f) WHERE r = 1)"


@query(
    "feature_lookup",
    f"WITH {_FEATURE_SQL} SELECT w.key, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT 'default:item:' || p_partkey || ':R:v1:text' AS key FROM part) w LEFT JOIN newest USING (key)",
)
def feature_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "part").select(F.concat(F.lit("default:item:"), F.col("p_partkey").cast("string"), F.lit(":R:v1:text")).alias("key"))
    found = features.lookup_features(_feature_table(spark, folder), wanted)
    return found.select("key", r6(F.col("vector")[0], "a"), r6(F.col("vector")[1], "b"))


@query("feature_key_count", f"WITH {_FEATURE_SQL} SELECT count(DISTINCT key) AS keys FROM f")
def feature_key_count(spark: SparkSession, folder: str) -> DataFrame:
    return features.distinct_key_count(_feature_table(spark, folder))


@query(
    "feature_get_or_compute",
    f"WITH {_FEATURE_SQL} SELECT w.key, round(CASE WHEN newest.key IS NULL THEN ('0x' || substr(sha256(w.key), 1, 2))::INT / 255.0::DOUBLE ELSE a END, 6) AS a FROM (SELECT 'default:item:' || p_partkey || CASE WHEN p_size > 25 THEN ':R' ELSE ':X' END || ':v1:text' AS key FROM part) w LEFT JOIN newest USING (key)",
)
def feature_get_or_compute(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("p_size") > 25, ":R").otherwise(":X")
    wanted = table(spark, folder, "part").select(F.concat(F.lit("default:item:"), F.col("p_partkey").cast("string"), kind, F.lit(":v1:text")).alias("key"))
    done = features.get_or_compute(_feature_table(spark, folder), wanted, lambda absent: absent.withColumn("vector", X.hash_vector("key", 2)))
    return done.select("key", r6(F.col("vector")[0], "a"))


@query(
    "vector_checksums",
    "SELECT vec_id AS pos, sha256(string_agg(printf('%.8f', v), ',' ORDER BY i)) AS checksum FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id",
)
def vector_checksums(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("pos"), X.vector_checksum(F.col("embedding").cast("array<double>")).alias("checksum"))


# --- screening and routing -------------------------------------------------------------------------------------------

_SCREEN_SQL = r"""cl AS (SELECT {k}, trim(regexp_replace(regexp_replace({t}, '[\p{{C}}\p{{Zl}}\p{{Zp}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g'), ' +', ' ', 'g')) AS c FROM {s}),
 e AS (SELECT *, regexp_matches(c, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b') AS has_email, regexp_replace(c, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[REDACTED_EMAIL]', 'g') AS c1 FROM cl),
 p AS (SELECT *, regexp_matches(c1, '\b\+?\d[\d\-() ]{{8,}}\d\b') AS has_phone, regexp_replace(c1, '\b\+?\d[\d\-() ]{{8,}}\d\b', '[REDACTED_PHONE]', 'g') AS c2 FROM e),
 d AS (SELECT *, regexp_matches(c2, '\b(?:\d[ -]*){{13,19}}\b') AS has_card, regexp_replace(c2, '\b(?:\d[ -]*){{13,19}}\b', '[REDACTED_CARD]', 'g') AS c3 FROM p),
 v AS (SELECT *, CASE WHEN c = '' THEN 'empty_input' WHEN length(c) > {n} THEN 'input_too_large' WHEN regexp_matches(c, '(?i)<\s*script') THEN 'script_injection'
   WHEN regexp_matches(c, '(?i)\b(select|union|drop|insert|delete|update)\b.+\b(from|table|into|where)\b') THEN 'sql_injection' WHEN contains(c, '../') OR contains(c, '..\') THEN 'path_traversal'
   WHEN regexp_matches(c, '(?i)ignore\s+previous\s+instructions|system\s+prompt') THEN 'prompt_injection' WHEN has_email OR has_phone OR has_card THEN 'pii_detected' ELSE 'ok' END AS reason FROM d)"""
_VERDICT_SQL = "reason, CASE reason WHEN 'ok' THEN 200 WHEN 'input_too_large' THEN 413 ELSE 400 END::BIGINT AS status, reason = 'ok' AS allowed, md5(CASE reason WHEN 'ok' THEN c WHEN 'pii_detected' THEN c3 ELSE '' END) AS sanitized_md5, CASE WHEN reason = 'pii_detected' THEN concat_ws(',', CASE WHEN has_email THEN 'email' END, CASE WHEN has_phone THEN 'phone' END, CASE WHEN has_card THEN 'card' END) ELSE '' END AS redactions"


def _verdicts(screened: DataFrame, *keys: str) -> DataFrame:
    return screened.select(*keys, "reason", F.col("status").cast("long").alias("status"), "allowed", F.md5("sanitized").alias("sanitized_md5"), F.array_join("redactions", ",").alias("redactions"))


@query("screen_conversations", f"WITH {_SCREEN_SQL.format(k='conv_id, turn', t='text', s='conversations', n=180)} SELECT conv_id, turn, {_VERDICT_SQL} FROM v")
def screen_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(screening.screen_text(table(spark, folder, "conversations")), "conv_id", "turn")


@query("screen_documents", f"WITH {_SCREEN_SQL.format(k='doc_id', t='text', s='documents', n=10000)} SELECT doc_id, {_VERDICT_SQL} FROM v")
def screen_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(screening.screen_text(table(spark, folder, "documents"), max_length=10000), "doc_id")


@query("screen_pages", f"WITH {_SCREEN_SQL.format(k='page_id', t='html', s='pages', n=1000000)} SELECT page_id, {_VERDICT_SQL} FROM v")
def screen_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(screening.screen_text(table(spark, folder, "pages"), "html", 1000000), "page_id")


@query(
    "screen_forms",
    f"""WITH fields AS (SELECT page_id AS form_id, 0 AS place, 'address' AS name, url AS t FROM pages UNION ALL SELECT page_id, 1, 'body', html FROM pages),
      {_SCREEN_SQL.format(k='form_id, place, name', t='t', s='fields', n=1000000)}
      SELECT form_id, coalesce(bool_and(reason = 'ok'), true) AS allowed, coalesce(min_by(reason || ':' || name, place) FILTER (reason <> 'ok'), 'ok') AS reason,
       coalesce(min_by(CASE reason WHEN 'input_too_large' THEN 413 ELSE 400 END, place) FILTER (reason <> 'ok'), 200)::BIGINT AS status FROM v GROUP BY form_id""",
)
def screen_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a form of its address and its body, whatever the verdict."""
    field = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))
    forms = table(spark, folder, "pages").select(F.col("page_id").alias("form_id"), F.array(field("address", "url"), field("body", "html")).alias("fields"))
    done = screening.screen_forms(forms, limits=screening.ScreenLimits(field_length=1_000_000))
    return done.select("form_id", "allowed", "reason", F.col("status").cast("long").alias("status"))


_ROUTE_WEIGHTS = {"movies": {"red": 3.0, "bolt": 1.0, "large anvil": 2.5}, "music": {"blue": 2.0, "ring": 1.5, "small": 1.0}, "books": {"gear": 2.0, "old": 1.0, "anvil": 0.5}}


def _route_sql(source: str, key: str, text: str, weights: dict[str, dict[str, float]], override: str) -> str:
    sums = []
    for domain, words in weights.items():
        hits = [f"CASE WHEN {'contains(t, ' + chr(39) + w + chr(39) + ')' if ' ' in w else 'list_contains(w, ' + chr(39) + w + chr(39) + ')'} THEN {v} ELSE 0.0 END" for w, v in words.items()]
        sums.append(f"({' + '.join(hits)})::DOUBLE AS {domain}")
    return f"""WITH x AS (SELECT {key}, lower({text}) AS t, {override} AS forced, regexp_extract_all(lower({text}), '[a-z]+') AS w FROM {source}), s AS (SELECT {key}, forced, {', '.join(sums)} FROM x),
      b AS (SELECT *, movies + music + books AS total, greatest(movies, music, books) AS best FROM s), c AS (SELECT *, CASE WHEN total > 0 THEN best / total ELSE 0.0 END AS conf FROM b)
      SELECT {key}, CASE WHEN forced IN ('movies', 'music', 'books') THEN forced WHEN conf < 0.4 THEN 'unknown' WHEN best = movies THEN 'movies' WHEN best = music THEN 'music' ELSE 'books' END AS domain,
       round(CASE WHEN forced IN ('movies', 'music', 'books') THEN 1.0 ELSE conf END, 6) AS confidence, CASE WHEN forced IN ('movies', 'music', 'books') THEN 'user_override' ELSE 'keyword' END AS method FROM c"""


@query("route_part_names", _route_sql("part", "p_partkey", "p_name", _ROUTE_WEIGHTS, "CASE WHEN p_size > 45 THEN 'books' WHEN p_size > 40 THEN 'games' END"))
def route_part_names(spark: SparkSession, folder: str) -> DataFrame:
    """With a word table made for these names, and an override that is sometimes unsupported."""
    parts = table(spark, folder, "part").withColumn("forced", F.when(F.col("p_size") > 45, "books").when(F.col("p_size") > 40, "games"))
    return screening.route_by_keywords(parts, "p_name", _ROUTE_WEIGHTS, override="forced").select("p_partkey", "domain", r6("confidence", "confidence"), "method")


@query("route_pages", _route_sql("pages", "page_id", "html", screening.KEYWORD_WEIGHTS, "NULL"))
def route_pages(spark: SparkSession, folder: str) -> DataFrame:
    return screening.route_by_keywords(table(spark, folder, "pages"), "html").select("page_id", "domain", r6("confidence", "confidence"), "method")


# --- event log -------------------------------------------------------------------------------------------------------


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_type").alias("name"), F.from_json("props", "map<string,string>").alias("tags"), "value", F.col("event_id").alias("seq"))


@query("metric_counters", "SELECT event_type || '|k=' || json_extract_string(props, '$.k') AS key, round(sum(value), 6) AS total FROM events GROUP BY 1")
def metric_counters(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.counters(_samples(spark, folder)).select("key", r6("total", "total"))


@query(
    "metric_percentiles",
    """WITH r AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      SELECT key, max(n) AS samples, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN value END) AS p95, max(CASE WHEN i = round_even((n - 1) * 0.99, 0) THEN value END) AS p99 FROM r GROUP BY key""",
)
def metric_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.percentiles(_samples(spark, folder).withColumnRenamed("name", "key").select("key", "value"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    profile = F.when(F.col("user_id") % 3 == 0, "lean").when(F.col("user_id") % 3 == 1, "mid").otherwise("aggressive")
    return e.select(F.col("ts"), profile.alias("profile"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"))


_REQUEST_SQL = "rq AS (SELECT ts, CASE user_id % 3 WHEN 0 THEN 'lean' WHEN 1 THEN 'mid' ELSE 'aggressive' END AS profile, event_type = 'error' AS failed, value > CASE user_id % 3 WHEN 0 THEN 450 WHEN 1 THEN 300 ELSE 220 END AS slow FROM events)"


@query("request_counters", f"WITH {_REQUEST_SQL} SELECT profile, count(*) AS requests, sum(failed::INT)::BIGINT AS errors, sum(slow::INT)::BIGINT AS slo_violations FROM rq GROUP BY profile")
def request_counters(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.request_counters(_requests(spark, folder), ["profile"])


# Spans: one trace per user and day; its first event is the root; sign-ups are left open.
_SPANS_SQL = """sp AS (SELECT user_id || '-' || CAST(ts AS DATE) AS trace_id, event_id AS span_id, event_type AS name, epoch_us(ts) / 1000.0 AS start_ms, CASE WHEN event_type <> 'signup' THEN epoch_us(ts) / 1000.0 + value END AS end_ms,
  event_type = 'error' AS err, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS root FROM events)"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    start = F.unix_micros("ts") / 1000.0
    rows = e.select(
        trace.alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), start.alias("start_ms"),
        F.when(F.col("event_type") != "signup", start + F.col("value")).alias("end_ms"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "unset").otherwise("ok").alias("status"),
    )
    roots = rows.groupBy("trace_id").agg(F.min(F.struct("start_ms", "span_id")).alias("r")).select("trace_id", F.col("r.span_id").alias("root_id"))
    linked = rows.join(roots, "trace_id")
    parent = F.when(F.col("span_id") != F.col("root_id"), F.col("root_id"))
    return linked.withColumn("parent_id", parent).withColumn("depth", F.when(parent.isNull(), 0).otherwise(1))


@query("trace_summary", f"WITH {_SPANS_SQL} SELECT trace_id, round(max(CASE WHEN root THEN end_ms - start_ms END), 3) AS duration_ms, count(*) AS spans, sum((err OR (end_ms IS NULL AND NOT root))::INT)::BIGINT AS errors FROM sp GROUP BY trace_id")
def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    done = eventlog.trace_summary(_spans(spark, folder))
    return done.select("trace_id", F.round("duration_ms", 3).alias("duration_ms"), "spans", "errors")


@query("trace_waterfall", f"WITH {_SPANS_SQL} SELECT trace_id, span_id, name, (NOT root)::BIGINT AS depth, round(start_ms - min(start_ms) OVER (PARTITION BY trace_id), 3) AS offset_ms, round(coalesce(end_ms - start_ms, 0), 3) AS width_ms FROM sp")
def trace_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    done = eventlog.waterfall(_spans(spark, folder))
    return done.select("trace_id", "span_id", "name", F.col("depth").cast("long").alias("depth"), F.round("offset_ms", 3).alias("offset_ms"), F.round("width_ms", 3).alias("width_ms"))


@query("stage_breakdown", f"WITH {_SPANS_SQL} SELECT trace_id, name, round(sum(coalesce(end_ms - start_ms, 0)), 3) AS total_ms FROM sp GROUP BY trace_id, name")
def stage_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.stage_breakdown(_spans(spark, folder)).select("trace_id", "name", F.round("total_ms", 3).alias("total_ms"))


@query("error_spans", f"WITH {_SPANS_SQL} SELECT trace_id, span_id FROM sp WHERE err")
def error_spans(spark: SparkSession, folder: str) -> DataFrame:
    return eventlog.error_spans(_spans(spark, folder)).select("trace_id", "span_id")


@query("cache_hit_rate", "SELECT CAST(user_id % 4 AS VARCHAR) AS scope, count(*) AS lookups, sum((event_type = 'click')::INT)::BIGINT AS hits, round(avg((event_type = 'click')::INT), 6) AS hit_rate FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def cache_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks are hits, views are misses, everything else is a write."""
    e = table(spark, folder, "events")
    rows = e.select((F.col("user_id") % 4).cast("string").alias("scope"), F.when(F.col("event_type").isin("click", "view"), "get").otherwise("put").alias("action"), (F.col("event_type") == "click").alias("hit"))
    done = eventlog.cache_hit_rate(rows)
    return done.select("scope", "lookups", "hits", r6("hit_rate", "hit_rate"))
