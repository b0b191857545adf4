"""Benchmark the headline queries.

Runs a fixed set of registered queries over ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed in full through the no-op sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skiff.plans import QUERIES  # noqa: E402
from skiff.session import get_session  # noqa: E402

HEADLINE = [
    "market_availability",
    "market_scenarios",
    "market_price_summary",
    "market_calibration",
    "serving_per_second",
    "serving_test_totals",
    "serving_saturation",
    "telemetry_node_spans",
    "telemetry_run_series",
    "telemetry_outages",
    "corpus_manifest",
    "corpus_eval_windows",
    "corpus_token_checksum",
    "exp_throughput",
    "exp_clean_projection",
    "fleet_restore_point",
    "fleet_stall_clock",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [a for a in sys.argv[1:]] or HEADLINE
    spark = get_session(
        app="skiff-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=max(8, cpus * 2),
        extra={"spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # warm the JVM (class loading, codegen caches) outside the timings
    QUERIES["serving_per_second"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
