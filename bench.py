"""Seconds per headline query on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.registry import load_all  # noqa: E402
from millrace.session import build_session  # noqa: E402

HEADLINE = """
group_totals metric_actions grouped_multi_aggregate monthly_trend missingness correlation_top_pairs group_percentiles
exact_numeric_profile exact_top_values numeric_profile quality_score duplicate_rows one_pass_profile chart_histogram
rate_drivers apply_preparation personal_data_scan pseudonyms target_leakage capped_strata temporal_holdout running_total
lag_lead fill_along_time order_part_cosine share_with_match adoption reliability sessions interrupted_agents
unique_chunks chunks nearest_vectors dataset_relevance claim_counts stream_rollup models_touching_pii transferred_table
regression_metrics
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "millrace-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf.group(1)) if sf else sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
