"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewatch.plans.catalog import QUERIES
from tidewatch.session import local_session

# In the order of the pipeline: a query that needs an earlier table pays for it only if no other did.
HEADLINE = [
    "summarize_records",
    "expand_schedule",
    "assign_loads",
    "aggregate_metrics",
    "arrival_profile",
    "volume_baseline",
    "detect_volume",
    "incident_candidates",
    "quality_scorecard",
    "replay",
    "run_backtest",
    "assign_loads_multi_slot",
    "ingest_dedup",
    "infer_contract",
    "business_days_between",
    "insights_by_code",
    "response_times",
    "reconcile",
    "scan_systemic",
    "append_audit_chain",
    "verify_decisions",
    "check_grounding",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    spark = local_session(cpus, n)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 2)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
