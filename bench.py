"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver). One warm-up pass on the
smallest fixtures runs first so JIT and class loading are not timed; each
query is then timed three times and the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeweave.plans.registry import QUERIES  # noqa: E402
from lakeweave.session import local_session  # noqa: E402

HEADLINE = [
    "a2_tpch_q1", "a3_tpch_q3", "a4_tpch_q6", "a5_tpch_q10", "a6_tpch_q19",
    "a1_rpt_revenue_by_region", "t3_fct_orders_incremental", "w1_dedupe_order_items",
    "q15_checkpoint_staging", "g5_secure_select_analyst", "g8_verify_chain", "m7_burn_rate_alerts",
    "s6_extract_text", "q16_pii_scan_documents",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    names = [n for n in HEADLINE if n in QUERIES]
    warm = "/root/testdata/sf0.001"
    for n in names:
        run(QUERIES[n](spark, warm))
    times = {}
    for n in names:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            run(QUERIES[n](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
