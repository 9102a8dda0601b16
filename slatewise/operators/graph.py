"""Catalogue graph: vertices, edges, structural retrieval, neighbour means and random walks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import expressions as X
from slatewise.operators.scale import HOT_GROUP_ROWS, bounded_broadcast, by_shuffle, running_sums, top_n_per_group
from slatewise.operators.vectors import exact_search
from slatewise.session import written


def _clean(column: str) -> Column:
    return X.blank_to_null(F.lower(F.col(column)))


def catalog_edges(catalog: DataFrame, people: dict[str, str], genres: str | None, title: str = "title", pos: str = "pos") -> DataFrame:
    """Edges (src_type, src, dst_type, dst, relation, weight) of item and title vertices.

    ``people`` maps a column to its vertex type (director, actor, ...); ``genres`` is a blank-separated column. One scan:
    all edges of a row are built as one array and exploded.
    """
    relation = {"director": "directed_by", "actor": "acted_in"}
    item, name = F.col(pos).cast("string"), _clean(title)
    targets = [F.struct(F.lit(kind).alias("type"), _clean(c).alias("id"), F.lit(relation.get(kind, kind)).alias("relation")) for c, kind in people.items()]
    listed = F.array(*targets) if targets else F.array().cast("array<struct<type:string,id:string,relation:string>>")
    if genres:
        words = X.blank_tokens(F.coalesce(F.col(genres), F.lit("")))
        listed = F.concat(listed, F.transform(words, lambda g: F.struct(F.lit("genre").alias("type"), g.alias("id"), F.lit("has_genre").alias("relation"))))
    listed = F.filter(listed, lambda t: t["id"].isNotNull())
    edge = lambda st, s, t: F.struct(
        F.lit(st).alias("src_type"), s.alias("src"), t["type"].alias("dst_type"), t["id"].alias("dst"), t["relation"].alias("relation")
    )
    own = F.struct(F.lit("movie").alias("type"), item.alias("id"), F.lit("is_movie").alias("relation"))
    rows = F.concat(
        F.array(edge("movie_title", name, own)),
        F.transform(listed, lambda t: edge("movie", item, t)),
        F.transform(listed, lambda t: edge("movie_title", name, t)),
    )
    return catalog.filter(name.isNotNull()).select(F.inline(rows)).withColumn("weight", F.lit(1.0))


def catalog_vertices(edges: DataFrame, last_write_wins: bool = False, order: dict[str, int] | None = None) -> DataFrame:
    """Distinct (type, id). With ``last_write_wins`` one type per id, the one with the highest ``order``."""
    ends = edges.select(F.col("src_type").alias("type"), F.col("src").alias("id")).unionByName(
        edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"))
    )
    if not last_write_wins:
        return ends.distinct()
    rank = order or {"movie": 0, "movie_title": 1, "director": 2, "actor": 3, "genre": 4}
    level = F.create_map(*[F.lit(v) for pair in rank.items() for v in pair])[F.col("type")]
    return ends.groupBy("id").agg(F.max_by("type", level).alias("type"))


def _vertex(kind: str, name: str) -> Column:
    return F.concat_ws("\u001f", kind, name)


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected, typed and weighted adjacency (node, neighbour, relation, weight); repeated edges stay repeated."""
    forward = edges.select(_vertex("src_type", "src").alias("node"), _vertex("dst_type", "dst").alias("neighbour"), "relation", "weight")
    backward = forward.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "relation", "weight")
    return forward.unionByName(backward)


def structural_search(
    edges: DataFrame, query_nodes: DataFrame, k: int = 20, candidate_type: str = "movie", hot_degree: int = 10_000,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Jaccard of neighbour sets between query vertices and vertices of ``candidate_type``; score > 0, best ``k``.

    ``query_nodes``: query_id, type, id. Candidate ids are numbers and give the tie order. Pairs of ``exclude`` (query_id,
    pos) are left out before the cut.

    A neighbour shared by more than ``hot_degree`` candidates would pair every query with all of them. Candidates that
    meet a query only in such hot neighbours all score alike when they agree in their hot neighbours and in their
    degree, so each such class stands for its first ``k`` members, and as many more as the query leaves out of it, which is
    exact for a top-k. All others are found through their rare neighbours.
    """
    links = neighbours(edges).select("node", "neighbour").distinct()
    prefix = candidate_type + "\u001f"
    is_candidate = F.col("node").startswith(prefix)
    cand = links.filter(is_candidate).select(F.expr(f"cast(substring(node, {len(prefix) + 1}) as bigint)").alias("pos"), "neighbour")
    degree = cand.groupBy("pos").agg(F.count(F.lit(1)).alias("deg"))
    spread = cand.groupBy("neighbour").agg(F.count(F.lit(1)).alias("__n"))
    hot = spread.filter(F.col("__n") > hot_degree).select("neighbour")
    wanted = query_nodes.select("query_id", _vertex("type", "id").alias("node"))
    q = wanted.join(by_shuffle(links), "node").select("query_id", "neighbour", F.col("node").alias("__self"))
    q_degree = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("qdeg"), F.first("__self").alias("__self"))
    # Hot neighbours are at most edges / hot_degree rows.
    hot = bounded_broadcast(hot)
    rare_pairs = (
        cand.join(hot, "neighbour", "left_anti")
        .join(by_shuffle(q.select("query_id", "neighbour")), "neighbour")
        .groupBy("query_id", "pos")
        .agg(F.count(F.lit(1)).alias("rare"))
    )
    hot_sets = cand.join(hot, "neighbour").groupBy("pos").agg(F.sort_array(F.collect_set("neighbour")).alias("hot_set"))
    q_hot = q.join(hot, "neighbour").groupBy("query_id").agg(F.sort_array(F.collect_set("neighbour")).alias("q_hot"))
    empty = F.array().cast("array<string>")
    both = F.size(F.array_intersect(F.coalesce("hot_set", empty), F.coalesce("q_hot", empty)))
    rare = (
        rare_pairs.join(by_shuffle(degree), "pos").join(by_shuffle(hot_sets), "pos", "left").join(by_shuffle(q_hot), "query_id", "left")
        .select("query_id", "pos", "deg", (F.col("rare") + both).alias("both"))
    )
    classed = hot_sets.join(by_shuffle(degree), "pos")
    out_of = None
    if exclude is not None:
        exclude = written(exclude.select("query_id", "pos").distinct(), "exclude")
        out_of = written(exclude.join(by_shuffle(classed), "pos").groupBy("query_id", "hot_set", "deg").agg(F.count(F.lit(1)).alias("__out")), "exclude")
    most_out = 0 if out_of is None else out_of.agg(F.coalesce(F.max("__out"), F.lit(0))).first()[0]
    members = top_n_per_group(classed, ["hot_set", "deg"], [F.col("pos")], k + 1 + most_out, "__m")
    members = written(members.withColumn("__block", F.floor((F.col("__m") - 1) / (k + 1))), "members")
    classes = members.select("hot_set", "deg").distinct().withColumn("neighbour", F.explode("hot_set"))
    q_classes = (
        q.select("query_id", "neighbour").join(by_shuffle(classes), "neighbour").groupBy("query_id", "hot_set", "deg").agg(F.count(F.lit(1)).alias("both"))
    )
    if out_of is None:
        q_classes = q_classes.withColumn("__out", F.lit(0).cast("long"))
    else:
        q_classes = q_classes.join(by_shuffle(out_of), ["query_id", "hot_set", "deg"], "left").fillna(0, ["__out"])
    # The first k + 1 + out members lie in so many blocks of k + 1.
    opened = q_classes.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__out") + k) / (k + 1)))))
    met = opened.join(by_shuffle(members), ["hot_set", "deg", "__block"]).filter(F.col("__m") <= F.col("__out") + (k + 1))
    common = met.select("query_id", "pos", "deg", "both")
    pairs = rare.unionByName(common).groupBy("query_id", "pos").agg(F.first("deg").alias("deg"), F.max("both").alias("both"))
    scored = (
        pairs.join(by_shuffle(q_degree), "query_id")
        .filter(F.concat(F.lit(prefix), F.col("pos").cast("string")) != F.col("__self"))
        .withColumn("score", F.col("both") / (F.col("deg") + F.col("qdeg") - F.col("both")))
        .select("query_id", "pos", "score")
    )
    if exclude is not None:
        scored = scored.join(by_shuffle(exclude), ["query_id", "pos"], "left_anti")
    return top_n_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("pos")], k)


def neighbour_mean(edges: DataFrame, features: DataFrame, hops: int = 1) -> DataFrame:
    """``hops`` rounds of [own vector, mean of the neighbours' vectors]; repeated edges count repeatedly.

    ``features``: node, vector. A node whose neighbours have no vector gets zeros for the mean.
    """
    links = neighbours(edges).groupBy("node", "neighbour").agg(F.count(F.lit(1)).alias("times"))
    current = features.select("node", "vector")
    for _ in range(hops):
        cells = current.select(F.col("node").alias("neighbour"), F.posexplode("vector").alias("i", "v"))
        sums = (
            links.join(cells, "neighbour")
            .groupBy("node", "i")
            .agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
            # One entry per dimension.
            .groupBy("node")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))
        )
        current = current.join(sums, "node", "left").select(
            "node", F.concat("vector", F.coalesce("mean", F.transform("vector", lambda x: F.lit(0.0)))).alias("vector")
        )
    return current


@dataclass(frozen=True)
class GraphLayer:
    """One round of messages: ``weights`` holds one row of 2 d numbers per output, for [own vector, mean of the neighbours]."""

    weights: Sequence[Sequence[float]]
    bias: Sequence[float] | None = None


def _linear(layer: GraphLayer, last: bool) -> Callable[[Column], Column]:
    matrix = np.array(layer.weights, dtype=float)
    bias = np.zeros(len(matrix)) if layer.bias is None else np.array(layer.bias, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(both: pd.Series) -> pd.Series:
        if not len(both):
            return pd.Series([], dtype=object)
        out = np.stack(both.to_numpy()) @ matrix.T + bias
        if not last:
            return pd.Series(list(np.maximum(out, 0.0)))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(norms > 0.0, norms, 1.0)))

    return apply


def graph_embeddings(edges: DataFrame, features: DataFrame, layers: Sequence[GraphLayer]) -> DataFrame:
    """(node, vector) after the layers: each maps [own vector, mean of the neighbours'] linearly; all but the last cut at zero,
    the last gives unit vectors (a zero vector stays zero).

    ``features``: node, vector; nodes without one take no part. Repeated edges count repeatedly; a node whose neighbours
    have no vector gets zeros for their mean. One row per link carries a whole vector, and map tasks sum what they hold
    before the shuffle, so a node of many links costs no more than one row per task.
    """
    links = written(neighbours(edges).groupBy("node", "neighbour").agg(F.count(F.lit(1)).alias("times")), "links")
    current = features.select("node", "vector").filter(F.col("vector").isNotNull())
    for number, layer in enumerate(layers):
        width, last = len(layer.weights[0]) // 2, number == len(layers) - 1
        met = links.join(current.select(F.col("node").alias("neighbour"), "vector"), "neighbour")
        mean = lambda i: (F.sum(F.col("vector")[i] * F.col("times")) / F.sum("times")).alias(f"__{i}")
        means = met.groupBy("node").agg(*[mean(i) for i in range(width)])
        means = means.select("node", F.array(*[F.col(f"__{i}") for i in range(width)]).alias("mean"))
        nothing = F.array(*[F.lit(0.0)] * width)
        both = current.join(means, "node", "left").select("node", F.concat("vector", F.coalesce("mean", nothing)).alias("both"))
        current = both.select("node", _linear(layer, last)(F.col("both")).alias("vector"))
        if not last:
            current = written(current, "layer")
    return current


def embedding_search(embeddings: DataFrame, query_nodes: DataFrame, k: int = 50, candidate_type: str = "movie") -> DataFrame:
    """Best ``k`` vertices of ``candidate_type`` per query vertex by the inner product of their unit vectors, the vertex itself
    left out. ``query_nodes``: query_id, type, id. Candidate ids are numbers and give the tie order. A query without a
    vector, or with a zero one, finds nothing."""
    prefix = candidate_type + "\u001f"
    number = F.expr(f"cast(substring(node, {len(prefix) + 1}) as bigint)")
    embeddings = written(embeddings, "embeddings")
    items = embeddings.filter(F.col("node").startswith(prefix)).select(number.alias("pos"), "vector", F.col("node").alias("item_group"))
    asked = query_nodes.select("query_id", _vertex("type", "id").alias("node")).join(embeddings, "node")
    return exact_search(items, asked.select("query_id", F.col("vector").alias("embedding"), F.col("node").alias("own_group")), k)


# Edges that one part of a vertex's edges holds on average.
EDGES_A_PART = 16


def _drawable_edges(edges: DataFrame, hot_rows: int) -> DataFrame:
    """(node, part, low, high, neighbour, degree, width): the draws low .. high - 1 of a vertex lead to the neighbour.

    The edges of a vertex stand one after the other on the line from 0 to its degree, parallel ones as one long edge. Parts
    of ``width`` draws cut that line, so that the edges of a hub spread over many keys; an edge is listed in each part that it
    touches. degree and width are those of the neighbour, where the walk is after the step.
    """
    links = neighbours(edges).groupBy("node", "neighbour").agg(F.count(F.lit(1)).alias("times"))
    placed = written(running_sums(links, ["node"], ["neighbour"], {"high": "times"}, hot_rows), "edges")
    ends = placed.groupBy("node").agg(F.sum("times").alias("degree"), F.count(F.lit(1)).alias("__n"))
    ends = ends.select("node", "degree", F.ceil(EDGES_A_PART * F.col("degree") / F.col("__n")).alias("width"))
    own = placed.join(ends.select("node", F.col("width").alias("__own")), "node").withColumn("low", F.col("high") - F.col("times"))
    part = lambda draw: F.floor(draw / F.col("__own"))
    parts = own.select("node", "neighbour", "low", "high", F.explode(F.sequence(part(F.col("low")), part(F.col("high") - 1))).alias("part"))
    return parts.join(ends.withColumnRenamed("node", "neighbour"), "neighbour")


def random_walk(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 3, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Uniform walks as rows (walk_id, step, node); a walk ends at a vertex without edges. ``starts``: walk_id, node.

    The draw of a step is the MD5 of (seed, step, walk) modulo the vertex's degree, and leads to the neighbour whose edges,
    in the order of the neighbours' names, hold it.
    """
    table = written(_drawable_edges(edges, hot_rows), "walk-edges")
    known = table.select(F.col("neighbour").alias("node"), "degree", "width").distinct()
    now = starts.select("walk_id", "node").join(known, "node", "left").withColumn("step", F.lit(0))
    path = now.select("walk_id", "node", "step")
    for step in range(1, steps + 1):
        drawn = now.filter(F.col("degree").isNotNull()).withColumn("draw", F.pmod(X.hex_number(seed, step, "walk_id"), F.col("degree")))
        asked = drawn.select("walk_id", "node", "draw", F.floor(F.col("draw") / F.col("width")).alias("part"))
        met = asked.join(table, ["node", "part"]).filter((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
        now = written(met.select("walk_id", F.col("neighbour").alias("node"), "degree", "width", F.lit(step).alias("step")), "walk")
        path = path.unionByName(now.select("walk_id", "node", "step"))
    return path
