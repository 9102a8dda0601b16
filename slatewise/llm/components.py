"""Connected components of a link table by alternating stars: every node ends up next to the smallest node of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long")), F.sum((F.xxhash64("src", "dst") / 65536).cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest of node and neighbours."""
    both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("src", "dst")
    least = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
    return both.filter("dst > src").join(least, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of the component), for nodes other than their root and for roots with links.

    ``links`` has src and dst; loops and repeated links do no harm. Every round writes its links to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. No node's links are gathered: minima are pre-aggregated
    and joined back, and a crowded node's join can be split.
    """
    edges = links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = stored(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("root"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)
