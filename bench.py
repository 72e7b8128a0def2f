"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

The stand-in tables are staged first (reported as ``stage_inputs``). Every query is
run once to warm up and once timed; its rows are computed and thrown away in the
executors, not collected.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stratified_folds", "turbo_sample", "feature_assembly", "frequency_encode", "oof_target_encode", "group_zscore_ratio",
    "pairwise_interactions", "row_global_aggs", "null_pattern_blocks", "subgroup_aggs", "cross_target_features",
    "column_profile", "correlation_scores", "feature_selection", "quantile_edges", "align_scores", "avg_tie_rank",
    "auc_by_model_target", "blend_two_models", "blend_three_models", "publish_submission",
]


def main() -> None:
    from takeup.plans.catalog import QUERIES
    from takeup.plans.inputs import Inputs
    from takeup.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    logging.disable(logging.CRITICAL)
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    Inputs(spark, sf_dir).warm()
    seconds["stage_inputs"] = round(time.perf_counter() - start, 3)
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(v for k, v in seconds.items() if k != "stage_inputs"), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
