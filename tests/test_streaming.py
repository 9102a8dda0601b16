"""Streams give what the same rows give in batch, also across a restart."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from slatewise.operators import labels
from slatewise.streaming import jobs

SCHEMA = "id long, user_id long, kind string, at timestamp"


def _events(n, seed, first_hour):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    times = sorted(first_hour + rng.random() * 200 for _ in range(n))
    return [(seed * 10_000 + i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "view", "purchase"]), start + datetime.timedelta(seconds=int(h * 3600))) for i, h in enumerate(times)]


def _labelled(rows):
    shown = rows.filter("kind = 'view'").select(F.col("id").alias("impression_id"), "user_id", F.col("at").alias("shown_at"))
    bought = rows.filter("kind = 'purchase'").select("user_id", F.col("at").alias("converted_at"))
    return jobs.delayed_labels(shown, bought, "12 hours", "1 hour")


def test_weights_are_written_by_the_stream_across_a_restart(spark):
    folder = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    delays = spark.createDataFrame([(2.0, 6), (6.0, 3), (12.0, 1)], "max_hours double, n long")
    run = lambda: jobs.run_available(
        jobs.weighted_labels(_labelled(jobs.read_stream(spark, f"{folder}/in", SCHEMA)), delays, 2.0), f"{folder}/out", f"{folder}/state"
    )
    first, second = _events(150, 1, 0), _events(150, 2, 200)
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    run()
    once = spark.read.parquet(f"{folder}/out").count()
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert 0 < once < len(rows) == len({r.impression_id for r in rows})

    views = [e for e in first + second if e[2] == "view"]
    last = max(e[3] for e in first + second)
    got = {r.impression_id: (r.label, r.delay_hours, r.weight) for r in rows}
    for number, user, _, at in views:
        hours = [(e[3] - at).total_seconds() / 3600 for e in first + second if e[2] == "purchase" and user is not None and e[1] == user]
        delay = min((h for h in hours if 0 < h <= 12), default=None)
        if at < last - datetime.timedelta(hours=14):
            share = None if delay is None else 0.6 if delay <= 2 else 0.9 if delay <= 6 else 1.0
            weight = 0.05 if delay is None else 1.0 if delay <= 2 else share
            assert got[number][0] == (delay is not None)
            assert (got[number][1] is None) == (delay is None) and abs(got[number][2] - weight) < 1e-9
            assert delay is None or abs(got[number][1] - delay) < 1e-6


def test_share_of_awkward_histograms(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (2, 0, None), (3, 0, 99.0), (4, 1, 1.0)], "id long, label int, delay_hours double")
    empty = labels.delay_distribution(spark.createDataFrame([], "max_hours double, n long"))
    assert [r.weight for r in labels.adjust_labels(rows, empty).orderBy("id").collect()] == [0.05, 0.05, 0.05, 1.0]
    some = labels.delay_distribution(spark.createDataFrame([(1.0, 1), (2.0, 3)], "max_hours double, n long"))
    for bound in (10, 1):
        assert [r.weight for r in labels.adjust_labels(rows, some, hot_rows=bound).orderBy("id").collect()] == [0.25, 0.05, 1.0, 1.0]
        each = labels.adjust_by_strategies(rows, some, hot_rows=bound)
        assert each.count() == 4 * len(labels.STRATEGIES)
    stream = spark.readStream.format("rate").load().select(F.lit(0).alias("label"), F.lit(1.0).alias("delay_hours"))
    with pytest.raises(ValueError):
        labels.adjust_labels(stream, some, hot_rows=1)
