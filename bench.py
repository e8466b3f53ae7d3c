"""Seconds per headline query: one JSON line.

Each query runs once to warm up and is then timed whole, from building the DataFrame to
the last row. `baseline` times the KPI refresh in the form in which every figure repeats
the star join, beside the same refresh from one pass.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import views  # noqa: E402
from checks.queries import QUERIES, joined  # noqa: E402
from orderlens.operators import kpis  # noqa: E402
from orderlens.plans.refresh import refresh  # noqa: E402
from orderlens.session import build_session, work_dir  # noqa: E402
from orderlens.sources.published import publish  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MEMORY = os.environ.get("BENCH_MEMORY", "16g")

HEADLINE = (
    "revenue_state_category",
    "kpi_summary",
    "kpi_summary_orders",
    "top_products",
    "top_products_by_name",
    "orders_by_state",
    "orders_by_state_all",
    "category_performance",
    "segment_analysis",
    "payment_metrics",
    "payment_success_rate",
    "revenue_by_minute",
    "revenue_velocity",
    "orders_joined",
    "orders_full15",
    "join_coverage",
    "dq_duplicates",
    "dq_report",
    "hot_size_band",
    "storage_stats",
    "archive_candidates",
    "archive_report",
    "cold_category_df",
    "stream_ingest_orders",
    "stream_revenue_by_minute",
    "upsert_customers",
)


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def refresh_in_one_pass(spark) -> None:
    refresh(spark, work_dir(spark, "serving"), *views.star(spark, SF_DIR))


def refresh_with_repeated_joins(spark) -> None:
    """One after the other, each from its own star join."""
    serving = work_dir(spark, "serving")
    rows = joined(spark, SF_DIR)
    rows.count()
    results = {
        "summary": kpis.summary(rows),
        "state_category": kpis.revenue_by_state_category(rows),
        "top_products": kpis.top_products(rows),
        "orders_by_state": kpis.orders_by_state(rows),
        "category_performance": kpis.category_performance(rows),
        "revenue_by_minute": kpis.revenue_by_minute(rows),
        "segment_analysis": kpis.segment_analysis(rows),
    }
    for name, result in results.items():
        publish(spark, serving, name, kpis.stamped(result))


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=int(CPUS),
        spark__driver__memory=MEMORY,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        query = QUERIES[name]
        run(query(spark, SF_DIR))
        times[name] = seconds(lambda: run(query(spark, SF_DIR)))
    refreshes = {}
    for name, action in (
        ("refresh_in_one_pass", refresh_in_one_pass),
        ("refresh_with_repeated_joins", refresh_with_repeated_joins),
    ):
        action(spark)
        refreshes[name] = seconds(lambda: action(spark))
    times["refresh_in_one_pass"] = refreshes["refresh_in_one_pass"]
    report = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "baseline": {
            "refresh_with_repeated_joins": refreshes["refresh_with_repeated_joins"]
        },
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
