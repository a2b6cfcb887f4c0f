"""Benchmark the headline queries.

Runs each registered headline query at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver), twice: the first (cold) run
pays code generation and JIT compilation of that plan, the second (warm) run
is the steady state of a long-lived session. ``value`` and ``queries`` are
the warm times; the cold times are reported alongside as ``cold_queries`` /
``cold_total``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q01_revenue_by_region", "q02_top_fraud_merchants", "q03_cohort_retention", "q04_fraud_map",
    "q05_audit_review", "q06_audit_by_actor", "q07_checkout_funnel", "q08_top_alerted_customers",
    "q09_daily_summary", "q11_top_fraud_categories", "q12_pipeline_health", "q14_daily_report",
    "q15_stg_transactions", "q19_fact_transaction", "q20_mart_revenue_daily", "q21_mart_fraud_analysis",
    "q22_search_feedback", "v05_validate", "s07_apply_changes", "x01_customer_features_reference",
    "x02_customer_features", "m10_m11_rule_score", "m12_psi", "t01_stream_ingest", "t06_request_rate",
]


def main() -> None:
    from paylake.session import build_session
    from paylake.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, app_name="paylake-bench",
                          extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    names = [n for n in HEADLINE if n in QUERIES and (not only or any(o in n for o in only))]
    QUERIES["q13_freshness"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    timings, cold = {}, {}
    for name in names:
        for store in (cold, timings):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "cold_total": round(sum(cold.values()), 3),
        "cold_queries": cold,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "shuffle_partitions": int(cpus) * 2,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
