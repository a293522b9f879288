"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the
data and the local cores. Every query runs to a no-op sink, so all rows are
produced and none is collected; the time is the best of BENCH_RUNS (default 1)
after one shared warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import all_entries
from millrace.session import build_session

HEADLINE = [
    "inventory_pareto", "sales_summary_cube", "stock_aging", "fifo_layers", "inventory_value", "landed_cost_amt",
    "fifo_allocate", "apply_movements", "explode_bom", "rolled_cost", "low_level_codes", "run_mrp",
    "forecast_ma3", "forecast_accuracy", "price", "supplier_ranking", "receive_po_lines", "convert_uom",
    "duplicate_blocks", "reachable", "phase_metrics", "stream_balances", "stream_moving_average",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(entries["inventory_by_warehouse"].run(spark, folder))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.time()
            sink(entries[name].run(spark, folder))
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
