"""The jobs an operator of the pipeline runs, one command each.

    spark-submit orderlens/jobs.py ingest --servers host:9092 --root R --serving S
    spark-submit orderlens/jobs.py refresh --root R --serving S
    spark-submit orderlens/jobs.py quality --root R --serving S
    spark-submit orderlens/jobs.py health --root R --serving S [--cold C]
    spark-submit orderlens/jobs.py archive --root R --cold C
    spark-submit orderlens/jobs.py cold --path C/archives/archive_id=.. [--root R]
    spark-submit orderlens/jobs.py show --serving S --name summary
    spark-submit orderlens/jobs.py sql --root R --query "SELECT .. FROM orders_joined"
    spark-submit orderlens/jobs.py maintain --root R

How often they run is up to whatever schedules them; `ingest` runs until it is stopped.
Results of checks are published like the KPIs, under `<serving>/checks`.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from orderlens import schemas  # noqa: E402
from orderlens.functions.text import json_rows  # noqa: E402
from orderlens.operators import health, kpis, quality, star  # noqa: E402
from orderlens.plans import refresh as refresh_plan, tiering  # noqa: E402
from orderlens.session import build_session, shuffle_partitions_for  # noqa: E402
from orderlens.sources import cold, files  # noqa: E402
from orderlens.sources.events import read_events  # noqa: E402
from orderlens.sources.published import publish, published_count, read_published  # noqa: E402
from orderlens.sources.store import HotStore  # noqa: E402
from orderlens.sources.tables import register_views  # noqa: E402
from orderlens.streaming import figures, ingest  # noqa: E402


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    source = {"kind": "kafka", "servers": args.servers, "topic": args.topic}
    if args.path:
        source = {"kind": "files", "path": args.path}
    if args.most:
        limit = "maxFilesPerTrigger" if args.path else "maxOffsetsPerTrigger"
        source[limit] = str(args.most)
    events = read_events(spark, source)
    trigger = {"availableNow": True} if args.once else {"processingTime": args.every}
    if args.serving:
        query = figures.start_ingest_and_refresh(spark, events, args.root, args.serving, trigger)
    else:
        query = ingest.start_ingest(spark, events, args.root, trigger)
    query.awaitTermination()


def run_refresh(spark: SparkSession, args: argparse.Namespace) -> None:
    store = HotStore(spark, args.root)
    done = refresh_plan.refresh(
        spark,
        args.serving,
        store.orders(),
        store.customers(),
        store.products(),
        store.payments(),
    )
    if done:
        published_count(spark, args.serving).show()
    else:
        print("no orders, nothing published")


def _publish_check(spark: SparkSession, serving: str, name: str, result: DataFrame) -> None:
    root = f"{serving}/checks"
    publish(spark, root, name, kpis.stamped(result))
    read_published(spark, root, name).show(truncate=False)


def run_quality(spark: SparkSession, args: argparse.Namespace) -> None:
    report = quality.report(HotStore(spark, args.root).orders(), args.as_of)
    _publish_check(spark, args.serving, "data_quality", report)


def run_health(spark: SparkSession, args: argparse.Namespace) -> None:
    store = HotStore(spark, args.root)
    since = store.committed()
    time.sleep(args.wait)
    orders, payments = store.orders(), store.payments()
    checks = {
        "flow": health.flow_between(store.progress(), since, store.committed()),
        "coverage": star.join_coverage(orders, store.customers(), store.products()),
        "recent_rate": health.recent_rate(orders, args.as_of),
        "size_band": health.size_band(store.size()),
        "table_sizes": health.table_sizes(store.tables()),
        "payment_success": kpis.payment_success_rate(payments),
    }
    if args.cold and files.exists(spark, tiering.archives_path(args.cold)):
        archives = tiering.read_archives(spark, args.cold, schemas.ORDERS)
        checks["archives"] = health.archive_inventory(archives)
    for name, result in checks.items():
        _publish_check(spark, args.serving, name, result)


def run_archive(spark: SparkSession, args: argparse.Namespace) -> None:
    report = tiering.archive_old_orders(
        HotStore(spark, args.root),
        args.cold,
        tiering.cutoff_before(args.as_of, args.retention_minutes),
        args.database,
        args.archive_id,
        args.threshold_mb,
    )
    if report is None:
        print("nothing archived: below the threshold, or no order is old")
    else:
        report.show()


def _give(result: DataFrame, output: str | None, rows: int = 20) -> None:
    """The whole result as Parquet, or its first rows on the screen."""
    if output:
        result.write.parquet(output)
    else:
        result.show(rows, truncate=False)


def run_cold(spark: SparkSession, args: argparse.Namespace) -> None:
    archive = cold.read_archive(spark, args.path)
    results = {"total": cold.total(archive)}
    if "product" in archive.columns:
        results["category"] = cold.category_revenue(archive)
    elif args.root:
        products = HotStore(spark, args.root).products()
        results["category"] = cold.category_revenue_flat(archive, products)
    for name, result in results.items():
        _give(result, args.output and f"{args.output}/{name}")


def run_show(spark: SparkSession, args: argparse.Namespace) -> None:
    result = read_published(spark, args.serving, args.name)
    if result is None:
        print(f"{args.name} is not published")
    else:
        _give(result if args.output else json_rows(result), args.output, 100)


def run_sql(spark: SparkSession, args: argparse.Namespace) -> None:
    """SQL over the tables of the hot tier and over their join."""
    tables = HotStore(spark, args.root).tables()
    joined = star.orders_joined(tables["orders"], tables["customers"], tables["products"])
    register_views({**tables, "orders_joined": joined})
    _give(spark.sql(args.query), args.output, args.rows)


def run_maintain(spark: SparkSession, args: argparse.Namespace) -> None:
    """Not beside a running stream: the tier has one writer at a time."""
    store = HotStore(spark, args.root)
    store.finish_removal()
    store.compact()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orderlens")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, run, *needed: str) -> argparse.ArgumentParser:
        command = jobs.add_parser(name)
        command.set_defaults(run=run)
        for option in needed:
            command.add_argument(f"--{option}", required=True)
        return command

    command = job("ingest", run_ingest, "root")
    command.add_argument("--servers", default="localhost:9092")
    command.add_argument("--topic", default="orders")
    command.add_argument("--path", help="read files of JSON lines here in place of Kafka")
    command.add_argument("--serving", help="refresh and publish the KPIs after each batch")
    command.add_argument("--every", default="1 minute")
    command.add_argument(
        "--most", type=int, help="take at most so many offsets (files) in one batch"
    )
    command.add_argument("--once", action="store_true", help="take what is there and stop")
    job("refresh", run_refresh, "root", "serving")
    job("quality", run_quality, "root", "serving").add_argument("--as-of")
    command = job("health", run_health, "root", "serving")
    command.add_argument("--as-of")
    command.add_argument("--cold")
    command.add_argument(
        "--wait", type=float, default=10, help="seconds between the two looks at the flow"
    )
    command = job("archive", run_archive, "root", "cold")
    command.add_argument("--as-of")
    command.add_argument("--database", default="order_archive")
    command.add_argument("--archive-id")
    command.add_argument("--threshold-mb", type=float, default=health.ARCHIVE_AT_MB)
    command.add_argument(
        "--retention-minutes", type=float, default=tiering.RETENTION_MINUTES
    )
    output = {"help": "write the whole result here as Parquet in place of showing rows"}
    command = job("cold", run_cold, "path")
    command.add_argument("--root", help="hot tier, for the products")
    command.add_argument("--output", **output)
    job("show", run_show, "serving", "name").add_argument("--output", **output)
    command = job("sql", run_sql, "root", "query")
    command.add_argument("--rows", type=int, default=20)
    command.add_argument("--output", **output)
    job("maintain", run_maintain, "root")
    return top


def fit_shuffles(spark: SparkSession, root: str) -> None:
    """Reduce tasks for the orders there are, unless the session was given a number."""
    key = "spark.sql.shuffle.partitions"
    if not spark.sparkContext.getConf().contains(key):
        _, size = HotStore(spark, root).order_size()
        spark.conf.set(key, str(shuffle_partitions_for(size)))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"orderlens-{args.job}")
    if getattr(args, "root", None):
        fit_shuffles(spark, args.root)
    args.run(spark, args)


if __name__ == "__main__":
    main()
