"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with a ``noop`` write (all columns computed, no
driver-side collection); one warm-up query runs first.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from closebook.plans import catalog  # noqa: E402
from closebook.session import local_session  # noqa: E402

HEADLINE = [
    "clean_raw_columns", "period_from_description", "previous_workpaper", "ap_invoice_asof",
    "procurement_remarks", "status_stage1", "status_erm", "accrual_amount", "status_distribution",
    "accrued_by_account", "shape_pivot", "deposit_status", "installment_limit", "dedup_last",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    reg = catalog.load()
    names = [n for n in HEADLINE if n in reg.QUERIES]
    reg.QUERIES["erm_parse"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.time()
        reg.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
