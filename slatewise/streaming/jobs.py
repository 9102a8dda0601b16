"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slatewise.operators import labels
from slatewise.operators.bandits import beta_state
from slatewise.operators.eventlog import request_counters


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, only: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", only) if only else reader).parquet(path)


def ingest_distinct(stream: DataFrame, time: str, delay: str, key: str = "item_id") -> DataFrame:
    """Rows with a key, one per key within the watermark; state of older keys is dropped."""
    dated = stream.filter(F.col(key).isNotNull()).withWatermark(time, delay)
    return dated.dropDuplicatesWithinWatermark([key]).withColumn("ingested_at", F.current_timestamp())


def bandit_posteriors(rewards: DataFrame, prior_alpha: float = 1.0, prior_beta: float = 1.0) -> DataFrame:
    """Update mode: the newest alpha and beta of every item touched by a batch."""
    return beta_state(rewards, prior_alpha, prior_beta)


def delayed_labels(impressions: DataFrame, conversions: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Each impression once: with the first conversion of the same user within the horizon, or with label 0.

    ``impressions``: impression_id, user_id, shown_at; ``conversions``: user_id, converted_at. A row comes out when the
    watermark has passed its horizon, so no label changes afterwards. State is kept for horizon plus delay; later
    conversions are lost by design.
    """
    left = impressions.withWatermark("shown_at", delay).alias("i")
    right = conversions.withWatermark("converted_at", delay).alias("c")
    near = (
        (F.col("i.user_id") == F.col("c.user_id"))
        & (F.col("c.converted_at") > F.col("i.shown_at"))
        & (F.col("c.converted_at") <= F.col("i.shown_at") + F.expr(f"interval {horizon}"))
    )
    joined = left.join(right, near, "leftOuter").select("i.impression_id", F.col("i.user_id").alias("user_id"), "i.shown_at", "c.converted_at")
    first = joined.groupBy("impression_id", "user_id", "shown_at").agg(F.min("converted_at").alias("converted_at"))
    hours = (F.unix_micros("converted_at") - F.unix_micros("shown_at")) / 3.6e9
    return first.select(
        "impression_id", "user_id", "shown_at", "converted_at", F.col("converted_at").isNotNull().cast("int").alias("label"), hours.alias("delay_hours")
    )


def weighted_labels(labelled: DataFrame, delays: DataFrame, early_hours: float, strategy: str = "cdf") -> DataFrame:
    """Adds weight to the rows of ``delayed_labels`` as they come out. ``delays``: max_hours, n of earlier conversions.

    A conversion within ``early_hours`` is a sure positive; a later one counts as a negative that came late, weighted by the
    share of conversions that are in by then.
    """
    early = F.coalesce(F.col("delay_hours") <= early_hours, F.lit(False)).cast("int")
    known = labelled.withColumnRenamed("label", "__found").withColumn("label", early)
    weighted = labels.adjust_labels(known, labels.delay_distribution(delays), strategy)
    return weighted.drop("label", "reason").withColumnRenamed("__found", "label")


def windowed_counters(requests: DataFrame, time: str, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Requests, errors and latency violations per tumbling or sliding window and profile."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return request_counters(requests.withWatermark(time, delay), [span.alias("window"), "profile"])


def sessions(events: DataFrame, time: str, delay: str, gap: str, user: str = "user_id") -> DataFrame:
    """Sessions per user: events no further apart than ``gap``."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), user)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        F.sha2(F.concat_ws("|", F.col(user).cast("string"), F.col("session.start").cast("string")), 256).alias("session_id"),
        user, F.col("session.start").alias("started_at"), F.col("session.end").alias("ended_at"), "events",
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there now to Parquet and stops. ``checkpoint`` must lie in storage all executors share."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update mode: the changed rows of each batch go to ``batch=<number>`` below ``path``; a repeated batch replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def newest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Last written row of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
