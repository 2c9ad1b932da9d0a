"""Benchmark the headline operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed in full into Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver); the time per query is the best
of ``BENCH_REPEAT`` runs (default 3) after the session is warm.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import catalog  # noqa: E402
from millrace.session import get_session  # noqa: E402

# Headline set: the survey's benchmark list (D1, D6, D10, D16, C3, I8, L1) plus
# one sequential fold, one streaming job and the feed.
HEADLINE = [
    "d1_dashboard_kpis", "d6_sales_by_product", "d10_profit_by_product", "d16_receivables_aging",
    "c3_sales_documents", "i8_material_ledger", "l1_fk_orphans", "i12_order_lifecycle_replay",
    "i2_validate_sales_orders", "f2_notifications", "j1_stream_daily_sales",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", cpus * 2)),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g"),
                               "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    catalog._load_all()
    times = {}
    for name in only:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
