"""Headline queries, timed on the tables in $BENCH_SF_DIR with local[$BENCH_CPUS].  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kithgraph.plans import registry  # noqa: E402
from kithgraph.session import build_session  # noqa: E402

QUERIES = (
    "r01_unresolved_commitments", "r02_sentiment_drop", "r04_entity_scores", "r08_ranked_paths", "r09_policy_training", "r13_stakeholder_views",
    "j01_ego_network", "j02_two_hop_related_nodes", "j06_project_map", "j18_reasoning_paths", "j20_cosine_knn", "m06_connected_components",
    "m03_graph_embedding", "e08_preview_resolution", "b05_pair_classification", "s06_node_upsert", "s07_relationship_upsert",
    "x04_extraction_record", "q01_ranked_search", "w02_negative_streak", "k01_reflect_all", "t07_short_term_memory",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    plans = registry.load_all()
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else QUERIES)]
    times: dict[str, float] = {}
    for name in names:
        run = registry.bind(plans[name][0])
        took = []
        for _ in range(rounds + 1):  # the first run warms up
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
