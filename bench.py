"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fieldscope.plans.registry import load  # noqa: E402
from fieldscope.plans.trace_queries import events  # noqa: E402
from fieldscope.session import local_session  # noqa: E402

HEADLINE = [
    "trace_parse", "trace_thread_select", "trace_health", "run_features", "suffix_capacity", "diff_metrics", "diff_diversity",
    "segment_fields", "byte_gap_fill", "bit_resolve", "compare_evidence", "grouped_candidates", "group_summary", "distribution",
    "iqr_outliers", "correlation_pairs", "minmax_scale", "axis_probe_corr", "percentile_rank", "atomize", "packet_metrics",
    "micro_summary", "bitfield_metrics", "topk_eval", "match_by_payload", "nearest_label",
]


def timed(df) -> tuple[float, int]:
    """Seconds and rows of one full run."""
    seen = Observation()
    start = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return time.time() - start, seen.get["rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    warm = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    spark = local_session(cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times, rows = {}, {}
    # Trace questions read the stored parsed trace; writing it is a figure of its own.
    events(spark, warm).count()
    start = time.time()
    rows["trace_table"] = events(spark, sf_dir).count()
    times["trace_table"] = round(time.time() - start, 3)
    for name in HEADLINE:
        timed(queries[name](spark, warm))
        runs = []
        for _ in range(repeats):
            start = time.time()
            _, rows[name] = timed(queries[name](spark, sf_dir))
            runs.append(time.time() - start)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
        print(name, times[name], rows[name], file=sys.stderr, flush=True)
    version = spark.version
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir),
        "rows_out": rows, "cores": int(cpus), "spark": version, "repeats": repeats,
    }))


if __name__ == "__main__":
    main()
