"""The whole path from a batch of titles to ranked, re-ranked and explained slates, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators import coldstart, graph, policy, ranking, text_similarity, vectors as V
from slatewise.operators.scale import by_shuffle, top_n_per_group
from slatewise.session import reliable_checkpoint

SIGNALS = ranking.SIGNALS
CANDIDATE_COLUMNS = ("query_id", "item_id", "title", "list_pos", "score", "channel", *SIGNALS)
# Place of a candidate in the merged list: channel number times this plus its rank in the channel.
CHANNEL_STRIDE = 1_000_000


@dataclass(frozen=True)
class RecommendConfig:
    text_k: int = 200
    vector_k: int = 50
    graph_k: int = 20
    graph_weight: float = 0.3
    pre_k: int = 50
    final_k: int = 10
    max_per_cohort: int = 3
    max_per_group: int = 2
    cold_start: coldstart.ColdStartWeights = field(default_factory=coldstart.ColdStartWeights)


def _shape(rows: DataFrame, channel: str, number: int, **signals) -> DataFrame:
    """Candidate columns; ``rows`` carry their rank within the channel, which decides ties later on."""
    for name in SIGNALS:
        rows = rows.withColumn(name, signals.get(name, F.lit(0.0)))
    place = F.col("rank") + number * CHANNEL_STRIDE
    return rows.withColumn("channel", F.lit(channel)).withColumn("list_pos", place).select(*CANDIDATE_COLUMNS)


def merge_channels(candidates: DataFrame) -> DataFrame:
    """Highest score per (query, item), first listed on ties; the item keeps the place where it was first listed."""
    rest = [c for c in CANDIDATE_COLUMNS if c not in ("query_id", "item_id", "list_pos")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("list_pos"))).alias("best")
    merged = candidates.groupBy("query_id", "item_id").agg(best, F.min("list_pos").alias("list_pos"))
    return merged.select("query_id", "item_id", "list_pos", "best.*").select(*CANDIDATE_COLUMNS)


def rerank(candidates: DataFrame, metadata: DataFrame | None, config: RecommendConfig, model: ranking.LinearModel | None = None) -> DataFrame:
    """Pre-rank, fine rank (or learned model), exposure penalty, diversity. ``metadata``: item_id, cohort, category.

    Every window partitions by query_id or by more, so one exchange on query_id serves all of them, and after the pre-rank
    no slate is longer than ``pre_k``.
    """
    pre = ranking.pre_rank(candidates, config.pre_k, pos="list_pos")
    if model is None:
        top = ranking.fine_rank(pre, config.final_k)
    else:
        top = ranking.rank_by_model(pre.withColumn("base", F.col("score")), model, config.final_k, ("pre_rank",)).withColumn("score", F.col("model_score"))
    if metadata is None:
        top = top.withColumn("cohort", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    else:
        top = top.join(by_shuffle(metadata.select("item_id", "cohort", "category")), "item_id", "left")
    penalized = policy.cohort_exposure_penalty(top, config.max_per_cohort, hot_rows=None)
    penalized = penalized.withColumn("score", F.col("penalized_score")).withColumn("rank", F.col("new_rank")).drop("penalized_score", "new_rank")
    grouped = penalized.withColumn("group_key", X.diversity_group(F.col("title"), F.col("category")))
    done = policy.diversity_rerank(grouped, config.max_per_group, hot_rows=None)
    return done.withColumn("rank", F.col("new_rank")).drop("new_rank")


def recommend(
    queries: DataFrame,
    catalog: DataFrame,
    edges: DataFrame | None = None,
    vectors: DataFrame | None = None,
    metadata: DataFrame | None = None,
    model: ranking.LinearModel | None = None,
    config: RecommendConfig = RecommendConfig(),
    explore: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Ranked items for each query title.

    ``queries``: query_id, query_title, user_id (nullable), meta_score; ``catalog``: pos (popularity order), item_id,
    title in lower case, text, attribute_count; ``vectors``: pos, vector; ``edges`` as built by ``catalog_edges``.

    A title of the catalogue is answered by the text, vector and graph channels, topped up from cold start when they
    give fewer than ``final_k`` items. Any other title is answered by cold start alone.

    ``explore`` orders the merged candidates before they are ranked, for instance
    ``lambda rows, k: ucb_select(rows, state, k)``: it gets query_id, item_id, pos, score and more, with at most ``k`` rows of
    a query, and adds ``rank``. That order is the place that decides ties of the rankers; scores stay.
    """
    # A request that is listed more than once is one request: its rows would multiply in every join by query_id.
    asked = queries.distinct().withColumn("__title", F.lower(F.trim("query_title")))
    first = catalog.groupBy("title").agg(F.min("pos").alias("self_pos")).withColumnRenamed("title", "__title")
    asked = asked.join(by_shuffle(first), "__title", "left")
    known, unknown = asked.filter(F.col("self_pos").isNotNull()), asked.filter(F.col("self_pos").isNull())

    # Equal titles have equal channels: they are searched once and joined back.
    titles = known.select("__title", "self_pos").distinct()
    # A title is never recommended to itself: its items are left out of every channel before that is cut.
    grouped = catalog.withColumn("item_group", F.col("title"))
    texts = titles.join(by_shuffle(catalog.select(F.col("pos").alias("self_pos"), "text")), "self_pos")
    texts = texts.select(F.col("self_pos").alias("query_id"), "self_pos", "text", F.col("__title").alias("own_group"))
    found = text_similarity.text_candidates(grouped, texts, config.text_k)
    channels = [_shape(found, "hybrid_text_multimodal", 0, text=F.col("text"), multimodal=F.col("multimodal"))]
    if vectors is not None:
        asked_vectors = titles.join(by_shuffle(vectors.select(F.col("pos").alias("self_pos"), F.col("vector").alias("embedding"))), "self_pos")
        asked_vectors = asked_vectors.select(F.col("self_pos").alias("query_id"), "embedding", F.col("__title").alias("own_group"))
        items = V.usable_vectors(vectors).join(by_shuffle(grouped.select("pos", "item_group")), "pos")
        near = V.exact_search(items, asked_vectors, config.vector_k)
        near = near.join(by_shuffle(catalog.select("pos", "item_id", "title")), "pos")
        channels.append(_shape(near, "vector_index", 1, multimodal=F.col("score")))
    if edges is not None:
        nodes = titles.select(F.col("self_pos").alias("query_id"), F.lit("movie_title").alias("type"), F.col("__title").alias("id"))
        own = titles.join(by_shuffle(catalog.select(F.col("title").alias("__title"), "pos")), "__title").select(F.col("self_pos").alias("query_id"), "pos")
        linked = graph.structural_search(edges, nodes, config.graph_k, exclude=own).withColumn("score", F.col("score") * config.graph_weight)
        channels.append(_shape(linked.join(by_shuffle(catalog.select("pos", "item_id", "title")), "pos"), "graph", 2))
    merged = channels[0]
    for channel in channels[1:]:
        merged = merged.unionByName(channel)
    best = merge_channels(merged).withColumnRenamed("query_id", "self_pos")
    primary = known.select("query_id", "self_pos").join(by_shuffle(best), "self_pos").select(*CANDIDATE_COLUMNS)
    # Read twice below: once to see which queries are short of items, once for the slates.
    primary = reliable_checkpoint(primary)

    counts = primary.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"))
    short = known.join(by_shuffle(counts), "query_id", "left").filter(F.coalesce("__n", F.lit(0)) < config.final_k)
    needy = short.select("query_id", F.col("query_title").alias("query_text"), "user_id", "meta_score", (config.final_k - F.coalesce("__n", F.lit(0))).alias("__need"))
    fresh = unknown.select("query_id", F.col("query_title").alias("query_text"), F.lit(None).cast("string").alias("user_id"), "meta_score", F.lit(None).cast("long").alias("__need"))
    requests = reliable_checkpoint(fresh.unionByName(needy))
    candidates = primary
    if requests.limit(1).count():
        short_titles = requests.select("query_id").join(by_shuffle(known.select("query_id", "__title")), "query_id")
        own = short_titles.join(by_shuffle(catalog.select(F.col("title").alias("__title"), "pos")), "__title").select("query_id", "pos")
        listed = primary.join(by_shuffle(requests.select("query_id")), "query_id", "left_semi").join(by_shuffle(catalog.select("item_id", "pos")), "item_id").select("query_id", "pos")
        cold = coldstart.cold_start_candidates(requests.drop("__need"), catalog, config.cold_start, exclude=own.union(listed))
        cold = cold.join(by_shuffle(requests.select("query_id", "__need")), "query_id")
        kept = cold.filter(F.col("__need").isNull() | (F.col("rank") <= F.col("__need")))
        kept = coldstart.cold_start_signals(kept).withColumn("list_pos", F.col("rank") + 9 * CHANNEL_STRIDE)
        candidates = primary.unionByName(kept.select(*CANDIDATE_COLUMNS))

    if explore is not None:
        ordered = explore(candidates.withColumnRenamed("list_pos", "pos"), config.text_k + config.vector_k + config.graph_k + config.cold_start.top_k)
        candidates = ordered.withColumn("list_pos", F.col("rank")).select(*CANDIDATE_COLUMNS)
    slates = rerank(candidates, metadata, config, model)
    shown = slates.join(by_shuffle(asked.select("query_id", "query_title")), "query_id")
    final = top_n_per_group(shown.withColumnRenamed("rank", "__rank"), ["query_id"], [F.col("__rank")], config.final_k)
    shadowed = policy.shadow_score(final.withColumn("query_text", F.lit("")))
    keep = ["query_id", "query_title", "rank", "item_id", "title", "score", "shadow_score", "channel", "text", "multimodal", "popularity", "recency", "novelty"]
    return shadowed.select(*keep)
