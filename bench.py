"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma-separated names or
``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

from slatewise.queries.load import all_queries
from slatewise.session import build_session

HEADLINE = (
    "recommend_known_titles",
    "cold_start_candidates",
    "vector_exact_search",
    "vector_similar_items",
    "text_similarity_top_k",
    "similar_titles",
    "graph_structural_search",
    "score_normalization",
    "blend_channels_top_k",
    "rank_cascade",
    "diversity_rerank",
    "bandit_ucb_select",
    "ranking_metrics_mean",
    "impression_summary",
    "pairwise_hinge_loss",
    "listmle_loss",
    "lambdarank_loss",
    "auc_overall",
    "fairness_report",
    "off_policy_report",
    "experiment_lift",
    "delayed_label_weights",
    "bag_of_words",
    "entity_match_pairs",
    "longest_mention",
    "column_profile",
    "event_contract",
    "screen_documents",
    "route_pages",
    "feature_lookup",
    "metric_percentiles",
    "trace_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    registered = all_queries()
    names = list(registered) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", cores, 2 * int(cores), os.environ.get("BENCH_MEMORY", "16g"))
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        try:
            registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001
            print(f"{name}: {str(error)[:300]}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
