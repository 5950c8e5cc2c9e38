"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from alertsieve.plans import QUERIES  # noqa: E402
from alertsieve.session import build_session  # noqa: E402

HEADLINE = [
    "agreement_conditioned_sets",
    "raps_single_model",
    "hybrid_routing",
    "mondrian_confidence",
    "augrc",
    "coverage_curve",
    "per_class_thresholds",
    "multiclass_metrics",
    "ranking_metrics",
    "bootstrap_accuracy",
    "explanations",
    "temporal_split",
    "label_map_topk",
    "text_features",
    "keyword_category",
    "tfidf_top_terms",
    "profile_features",
    "group_rollup",
    "primary_downstream",
    "downstream_distance",
    "asof_match",
    "best_match_fallback",
    "related_chains",
    "all_series_features",
    "cusum",
    "gap_suppress",
    "detector_eval",
    "forecast_errors",
    "residual_scores",
    "knn_vote",
    "near_duplicates",
    "unified_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["coverage_curve"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
