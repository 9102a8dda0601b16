"""The driver's tables in the shape the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.operators.scale import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str, name: str) -> Column:
    """Rounded to six digits, without negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """part as catalogue: position = key, title = name, provider = brand, genre = type."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"),
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("provider"),
        F.col("p_type").alias("genre"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


CATALOG_SQL = """catalog AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_brand AS provider,
  p_type AS genre, p_size AS size, p_retailprice AS price FROM part)"""


def slates(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is one shown list; its lines in order of line number are the places."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount", "l_quantity"
    )
    placed = numbered(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "place")
    return placed.select(
        F.col("l_orderkey").alias("query_id"),
        (F.col("place") - 1).alias("pos"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.sqrt(F.col("l_extendedprice") / 100000.0).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("grade"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").alias("quantity"),
    )


SLATES_SQL = """slates AS (SELECT l_orderkey AS query_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  l_partkey AS item_id, l_suppkey AS supplier_id, sqrt(l_extendedprice / 100000.0) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS grade, l_discount AS discount, l_quantity AS quantity FROM lineitem)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.col("vec_id").cast("string").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("domain"),
        F.col("label").alias("label"),
    )


VECTORS_SQL = "vectors AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS vector, CAST(label AS VARCHAR) AS domain, label FROM embeddings)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Event times carry no zone; they are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def logged_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as logged decisions: reward by type, propensities from the event id, one experiment per event hour."""
    e = table(spark, folder, "events")
    return e.select(
        (F.col("user_id") % 7).alias("experiment"),
        F.when(F.col("event_type").isin("click", "purchase"), 1.0).otherwise(0.0).alias("reward"),
        ((F.col("event_id") % 9) / 10.0).alias("logging_propensity"),
        (0.1 + (F.col("event_id") % 7) / 10.0).alias("target_propensity"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000.0).alias("direct_estimate"),
    )


LOGGED_SQL = """logged AS (SELECT user_id % 7 AS experiment, CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END::DOUBLE AS reward,
  (event_id % 9) / 10.0::DOUBLE AS logging_propensity, 0.1::DOUBLE + (event_id % 7) / 10.0::DOUBLE AS target_propensity,
  CASE WHEN event_id % 4 <> 0 THEN value / 1000.0 END AS direct_estimate FROM events)"""


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score and a probability from their length."""
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")
    return joined.select(
        "doc_id",
        F.col("source").alias("query_id"),
        "lang",
        F.col("quality").alias("label"),
        "toxic",
        (F.col("n_chars") / 1000.0).alias("score"),
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("prediction"),
        F.col("doc_id").alias("pos"),
    )


LABELS_SQL = """scored AS (SELECT l.doc_id, d.source AS query_id, d.lang, l.quality AS label, l.toxic, d.n_chars / 1000.0::DOUBLE AS score,
  d.n_chars / (d.n_chars + 2000.0::DOUBLE) AS prediction, l.doc_id AS pos FROM labels l JOIN documents d USING (doc_id))"""
