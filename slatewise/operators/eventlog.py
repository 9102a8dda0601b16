"""Counters, percentiles, service levels, traces and cache rates from logged events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators.scale import HOT_GROUP_ROWS, running_sums

# p95 latency limits in milliseconds per service profile.
LATENCY_LIMITS = {"lean": 450.0, "mid": 300.0, "aggressive": 220.0}


def metric_key(name: str = "name", tags: str = "tags"):
    """Name and the tags in key order."""
    entries = F.array_sort(F.map_entries(F.coalesce(F.col(tags), F.create_map().cast("map<string,string>"))))
    return F.concat_ws("|", F.array(F.col(name)), F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy(metric_key().alias("key")).agg(F.sum("value").alias("total"))


def percentiles(samples: DataFrame, approximate: bool = False, hot_rows: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """p50, p95, p99 per key by nearest rank over all samples. ``samples``: key, value.

    Rank ``round half even ((n - 1) p)``. Equal values are counted first; running sums over the distinct values then say
    which value holds a rank. ``approximate`` uses a mergeable sketch instead.
    """
    if approximate:
        return samples.groupBy("key").agg(*[F.percentile_approx("value", p, 10000).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    counted = samples.groupBy("key", "value").agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sums(counted, ["key"], ["value"], {"__upto": "__n"}, hot_rows)
    total = counted.groupBy("key").agg(F.sum("__n").alias("samples"))
    rank = lambda p: F.bround((F.col("samples") - 1) * F.lit(p), 0)
    at = lambda p: F.max(F.when((rank(p) < F.col("__upto")) & (rank(p) >= F.col("__upto") - F.col("__n")), F.col("value")))
    joined = upto.join(total, "key")
    return joined.groupBy("key").agg(F.max("samples").alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def request_counters(requests: DataFrame, keys: list, limits: dict[str, float] | None = None) -> DataFrame:
    """Requests, errors (status >= 500) and latency violations per profile, grouped by ``keys``. Works on a stream."""
    table = F.create_map(*[F.lit(v) for pair in (limits or LATENCY_LIMITS).items() for v in pair])
    slow = F.col("latency_ms") > table[F.col("profile")]
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors"),
        F.sum(F.when(slow, 1).otherwise(0)).alias("slo_violations"),
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """Root duration, spans and errors per trace. Open children count as errors, an open root as ok.

    ``spans``: trace_id, span_id, parent_id, name, status, start_ms, end_ms (null while open).
    """
    root = F.col("parent_id").isNull()
    unset = F.coalesce(F.col("status"), F.lit("unset")) == "unset"
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) | (F.col("end_ms").isNull() & ~root & unset)
    return spans.groupBy("trace_id").agg(
        F.max(F.when(root, F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"),
        F.count(F.lit(1)).alias("spans"),
        F.sum(failed.cast("int")).alias("errors"),
    )


def waterfall(spans: DataFrame) -> DataFrame:
    """Offset from the trace's first span, width and depth per span; the start is one aggregate joined back."""
    first = spans.groupBy("trace_id").agg(F.min("start_ms").alias("__first"))
    return spans.join(first, "trace_id").select(
        "trace_id", "span_id", "name", "depth",
        (F.col("start_ms") - F.col("__first")).alias("offset_ms"),
        F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0.0)).alias("width_ms"),
    )


def stage_breakdown(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id", "name").agg(F.sum(F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0.0))).alias("total_ms"))


def error_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("status") == "error")


def cache_hit_rate(events: DataFrame) -> DataFrame:
    """Hits over lookups per scope. ``events``: scope, action, hit."""
    lookups = events.filter(F.col("action") == "get")
    return lookups.groupBy("scope").agg(
        F.count(F.lit(1)).alias("lookups"), F.sum(F.col("hit").cast("int")).alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate")
    )
