"""The registered queries: each operator over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import views
from orderlens import schemas
from orderlens.functions import text
from orderlens.functions.times import age_minutes, minute_label, moment, parse_iso
from orderlens.operators import health, kpis, minutes, pricing, quality, star
from orderlens.operators.changes import PRESENT, fold
from orderlens.plans import latest, refresh as refresh_plan, rollup, tiering
from orderlens.session import work_dir
from orderlens.sources import cold
from orderlens.sources.events import read_events, with_file_order
from orderlens.sources.published import (
    publish,
    published_count,
    published_names,
    published_or_compute,
    read_published,
)
from orderlens.sources.store import HotStore
from orderlens.sources.tables import register_views
from orderlens.streaming import decode, figures, ingest

Query = Callable[[SparkSession, str], DataFrame]

# Parameters that make each filter bite on the test tables.
NO_STATE = "NATION_0"
NO_CATEGORY = "ECONOMY"
NO_SEGMENT = "BUILDING"
MIN_REVENUE = 20_000_000
CUTOFF = "1998-01-01 00:00:00"
EARLIER_CUTOFF = "1996-01-01 00:00:00"
FRESH_AS_OF = "2024-01-31 00:05:00"
RATE_AS_OF = "2024-01-30 23:59:00"
GATE_MB = 10.0

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.orders_joined(*views.star(spark, sf_dir))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Rows that are read more than once, written to the shared folder the first time."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def _plain_times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in names})


# -- scans and projections -------------------------------------------------------------


@query("scan_orders")
def scan_orders(spark, sf_dir):
    return _double(views.fact(spark, sf_dir), "total_amount", "shipping_cost", "tax_amount")


@query("scan_customers")
def scan_customers(spark, sf_dir):
    return views.cust(spark, sf_dir)


@query("scan_products")
def scan_products(spark, sf_dir):
    return views.prod(spark, sf_dir)


@query("scan_payments")
def scan_payments(spark, sf_dir):
    return views.pay(spark, sf_dir)


@query("flatten_event")
def flatten_event(spark, sf_dir):
    return star.flatten_event(views.event_rows(spark, sf_dir))


@query("dim_defaults")
def dim_defaults(spark, sf_dir):
    """One state and one segment taken away, then defaults put in."""
    people = views.cust(spark, sf_dir)
    gaps = people.withColumns(
        {
            "state": F.nullif("state", F.lit(NO_STATE)),
            "segment": F.nullif("segment", F.lit(NO_SEGMENT)),
        }
    )
    return star.customer_dim(gaps)


@query("derive_order_measures")
def derive_order_measures(spark, sf_dir):
    """Discounts widened so that both ends of the clamp are met; factors of many decimals."""

    def exact(column: str, factor: str) -> Column:
        return F.col(column).cast("decimal(4,2)") * F.lit(factor).cast("decimal(9,8)")

    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_orderkey").alias("order_ref"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.lit(1.1).cast("decimal(4,2)") - exact("l_discount", "6.12345678")).alias(
            "discount_factor"
        ),
        exact("l_tax", "1.01234567").alias("tax_rate"),
        F.col("l_discount").alias("shipping_extra"),
    )
    priced = pricing.derive_order_measures(lines.join(views.prod(spark, sf_dir), "product_id"))
    amounts = ("unit_price", "total_amount", "tax_amount", "shipping_cost")
    return _double(priced.select("order_ref", "line", "product_id", *amounts), *amounts)


@query("order_text")
def order_text(spark, sf_dir):
    """Padded keys, and each row as JSON."""
    rows = views.fact(spark, sf_dir).select(
        text.order_key(F.col("order_id")).alias("order_id"),
        text.customer_key(F.col("customer_id")).alias("customer_id"),
        text.product_key(F.col("product_id")).alias("product_id"),
        "quantity",
        "order_status",
    )
    return text.json_rows(rows)


@query("iso_times")
def iso_times(spark, sf_dir):
    """ISO text parsed back, its minute, its first 19 characters and its age."""
    events = views.minutes(spark, sf_dir)
    now = moment(events, "timestamp", FRESH_AS_OF)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = events.select("order_id", iso.alias("iso")).withColumn("at", parse_iso("iso"))
    return parsed.select(
        "order_id",
        minute_label("at").alias("minute"),
        text.shown_time("iso").alias("shown"),
        age_minutes(F.col("at"), now).alias("age_minutes"),
    )


# -- joins -----------------------------------------------------------------------------


@query("join_orders_customers")
def join_orders_customers(spark, sf_dir):
    orders, customers, _ = views.star(spark, sf_dir)
    rows = star.join_customers(orders, customers)
    return rows.select("order_id", "customer_id", "customer_name", "customer_state")


@query("join_orders_products")
def join_orders_products(spark, sf_dir):
    orders, _, products = views.star(spark, sf_dir)
    rows = star.join_products(orders, products)
    return rows.select("order_id", "product_id", "product_name", "product_brand")


@query("orders_joined")
def orders_joined(spark, sf_dir):
    return _double(joined(spark, sf_dir), "total_amount")


def full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments = views.pay(spark, sf_dir)
    _, customers, products = views.star(spark, sf_dir)
    lines, heads = views.lines(spark, sf_dir), views.heads(spark, sf_dir)
    return star.orders_with_payments(lines, customers, products, payments, "order_ref", heads)


@query("orders_full15")
def orders_full15(spark, sf_dir):
    return _double(full_rows(spark, sf_dir), "total_amount", "shipping_cost", "tax_amount")


@query("join_coverage")
def join_coverage(spark, sf_dir):
    """With one state's customers and one category's products gone, so that orders are lost."""
    orders, customers, products = views.star(spark, sf_dir)
    return star.join_coverage(
        orders,
        customers.where(F.col("state") != NO_STATE),
        products.where(F.col("category") != NO_CATEGORY),
    )


@query("joined_view_sql")
def joined_view_sql(spark, sf_dir):
    """The joined view under a name, asked in SQL."""
    register_views({"orders_joined": joined(spark, sf_dir)})
    return spark.sql(
        """
        SELECT customer_segment, product_category, count(*) AS order_count,
               count(DISTINCT customer_id) AS unique_customers
        FROM orders_joined
        WHERE customer_state != 'Unknown'
        GROUP BY customer_segment, product_category
        HAVING sum(total_amount) > 50
        """
    )


# -- aggregations ----------------------------------------------------------------------


@query("kpi_summary")
def kpi_summary(spark, sf_dir):
    return kpis.summary(joined(spark, sf_dir))


@query("kpi_summary_orders")
def kpi_summary_orders(spark, sf_dir):
    return kpis.order_summary(views.fact(spark, sf_dir))


@query("revenue_state_category")
def revenue_state_category(spark, sf_dir):
    return kpis.revenue_by_state_category(
        joined(spark, sf_dir), MIN_REVENUE, 30, NO_STATE, NO_CATEGORY
    )


@query("top_products")
def top_products(spark, sf_dir):
    return kpis.top_products(joined(spark, sf_dir))


@query("top_products_by_name")
def top_products_by_name(spark, sf_dir):
    return kpis.top_products_by_name(full_rows(spark, sf_dir))


@query("orders_by_state")
def orders_by_state(spark, sf_dir):
    return kpis.orders_by_state(joined(spark, sf_dir), no_state=NO_STATE)


@query("orders_by_state_all")
def orders_by_state_all(spark, sf_dir):
    return kpis.orders_by_state_all(full_rows(spark, sf_dir))


@query("category_performance")
def category_performance(spark, sf_dir):
    return kpis.category_performance(joined(spark, sf_dir))


@query("segment_analysis")
def segment_analysis(spark, sf_dir):
    return kpis.segment_analysis(joined(spark, sf_dir))


@query("payment_metrics")
def payment_metrics(spark, sf_dir):
    return kpis.payment_metrics(full_rows(spark, sf_dir))


@query("payment_success_rate")
def payment_success_rate(spark, sf_dir):
    return kpis.payment_success_rate(views.pay(spark, sf_dir))


@query("aov_vs_base")
def aov_vs_base(spark, sf_dir):
    return kpis.order_value_against_base(kpis.summary(joined(spark, sf_dir)))


@query("orders_by_peak_hour")
def orders_by_peak_hour(spark, sf_dir):
    return kpis.orders_by_peak_hour(views.minutes(spark, sf_dir))


# -- minutes ---------------------------------------------------------------------------


def minute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.revenue_by_minute(views.minutes(spark, sf_dir))


@query("revenue_by_minute")
def revenue_by_minute(spark, sf_dir):
    return minute_rows(spark, sf_dir)


@query("latest_minutes")
def latest_minutes(spark, sf_dir):
    """The same minutes, found by looking back from a time near the last orders."""
    return latest.latest_minutes(views.minutes(spark, sf_dir), as_of=RATE_AS_OF)


@query("revenue_velocity")
def revenue_velocity(spark, sf_dir):
    return minutes.revenue_velocity(minute_rows(spark, sf_dir))


@query("orders_per_minute_latest")
def orders_per_minute_latest(spark, sf_dir):
    return minutes.latest_order_rate(minute_rows(spark, sf_dir))


@query("avg_revenue_10min")
def avg_revenue_10min(spark, sf_dir):
    return minutes.mean_recent_revenue(minute_rows(spark, sf_dir))


@query("revenue_last_30")
def revenue_last_30(spark, sf_dir):
    return minutes.last_minutes(minute_rows(spark, sf_dir))


# -- quality and health ----------------------------------------------------------------


@query("dq_duplicates")
def dq_duplicates(spark, sf_dir):
    return quality.duplicates(views.fact(spark, sf_dir))


@query("dq_nulls")
def dq_nulls(spark, sf_dir):
    return quality.nulls(views.dirty(spark, sf_dir))


@query("dq_invalid_amounts")
def dq_invalid_amounts(spark, sf_dir):
    return quality.invalid_amounts(views.dirty(spark, sf_dir))


@query("dq_freshness")
def dq_freshness(spark, sf_dir):
    return quality.freshness(views.minutes(spark, sf_dir), FRESH_AS_OF)


@query("dq_volume")
def dq_volume(spark, sf_dir):
    return quality.volume(views.fact(spark, sf_dir))


@query("dq_report")
def dq_report(spark, sf_dir):
    return quality.report(views.dirty(spark, sf_dir), FRESH_AS_OF)


@query("flow_between_snapshots")
def flow_between_snapshots(spark, sf_dir):
    """What the stream noted of its first batch and of its last: the files of two days' halves."""
    rows = views.event_rows(spark, sf_dir)
    late = parse_iso("order.timestamp") >= F.lit(CUTOFF).cast("timestamp")
    source = work_dir(spark, "events")
    store = hot_store(spark, "flow")
    count = views.table(spark, sf_dir, "lineitem").count()
    for part in (rows.where(~late), rows.where(late)):
        written_lines(text.json_rows(part), count, source)
        events = read_events(spark, {"kind": "files", "path": source})
        ingest.start_ingest(spark, events, store, {"availableNow": True}).awaitTermination()
    return health.flow_between(store.progress(), 0, store.committed())


@query("recent_order_rate")
def recent_order_rate(spark, sf_dir):
    return health.recent_rate(views.minutes(spark, sf_dir), RATE_AS_OF)


@query("hot_size_band")
def hot_size_band(spark, sf_dir):
    size = health.tier_size([hot_orders(spark, sf_dir)])
    return health.size_band(size, GATE_MB, GATE_MB / 2)


@query("archive_gate")
def archive_gate(spark, sf_dir):
    """Over the sizes that the hot tier noted as its batches were written."""
    store = hot_store(spark)
    orders = hot_orders(spark, sf_dir)
    late = F.col("timestamp") >= F.lit(CUTOFF).cast("timestamp")
    store.write_batch(0, {"orders": orders.where(~late)})
    store.write_batch(1, {"orders": orders.where(late)})
    return health.archive_gate(store.size(), GATE_MB)


@query("storage_stats")
def storage_stats(spark, sf_dir):
    names = ("lineitem", "orders", "customer", "part", "nation", "events")
    stats = health.storage_stats({n: views.table(spark, sf_dir, n) for n in names})
    return stats.select(
        "table_name", "row_count", "file_count", (F.col("size_mb") > 0).alias("has_size")
    )


# -- tiering ---------------------------------------------------------------------------


def hot_store(spark: SparkSession, label: str = "hot") -> HotStore:
    """An empty hot tier whose layout fits tables of a few orders a day."""
    return HotStore(spark, work_dir(spark, label), buckets=4, days=365)


def hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the layout of the hot tier."""
    return (
        views.fact(spark, sf_dir)
        .select(
            text.order_key(F.col("order_id")).alias("order_id"),
            text.customer_key(F.col("customer_id")).alias("customer_id"),
            text.product_key(F.col("product_id")).alias("product_id"),
            F.col("timestamp").cast("timestamp").alias("timestamp"),
            F.col("quantity").cast("int").alias("quantity"),
            F.lit(1.0).alias("unit_price"),
            F.col("total_amount").cast("double").alias("total_amount"),
            F.col("shipping_cost").cast("double").alias("shipping_cost"),
            F.col("tax_amount").cast("double").alias("tax_amount"),
            "order_status",
        )
        .select(*schemas.ORDERS.names)
    )


def archived(
    spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF
) -> tuple[HotStore, str, str, DataFrame]:
    """A store with all orders after one archive run: store, folder, database, report."""
    store = hot_store(spark)
    store.write_batch(0, {"orders": hot_orders(spark, sf_dir)})
    folder = work_dir(spark, "cold")
    database = f"archive_{uuid.uuid4().hex}"
    report = tiering.archive_old_orders(
        store, folder, cutoff, database, archive_id="archive_1", threshold_mb=0
    )
    return store, folder, database, report


def _order_rows(orders: DataFrame) -> DataFrame:
    return _plain_times(
        orders.select("order_id", "customer_id", "timestamp", "quantity", "total_amount"),
        "timestamp",
    )


@query("archive_candidates")
def archive_candidates(spark, sf_dir):
    """Old orders of the hot tier, from the days up to the cut-off's."""
    store = hot_store(spark)
    store.write_batch(0, {"orders": hot_orders(spark, sf_dir)})
    return _order_rows(tiering.candidates(store.dated_orders(), CUTOFF))


@query("archive_write")
def archive_write(spark, sf_dir):
    """Two archives under one path, the second written twice, from orders that are joined once."""
    folder = work_dir(spark, "cold")
    orders = _kept(tiering.candidates(hot_orders(spark, sf_dir), CUTOFF), work_dir(spark, "orders"))
    old = tiering.candidates(orders, EARLIER_CUTOFF)
    rest = tiering.remainder(orders, EARLIER_CUTOFF)
    tiering.write_archive(old, folder, "archive_1")
    tiering.write_archive(old, folder, "archive_2")
    tiering.write_archive(rest, folder, "archive_2")
    rows = tiering.read_archives(spark, folder, orders.schema)
    return rows.select("archive_id", "order_id", "total_amount")


@query("archive_manifest")
def archive_manifest(spark, sf_dir):
    _, _, database, _ = archived(spark, sf_dir)
    rows = _plain_times(tiering.manifest(spark, database), "threshold_date")
    return rows.select("archive_id", "source", "threshold_date", "record_count", "format")


@query("archive_ids")
def archive_ids(spark, sf_dir):
    """The id of an archive made at each order's time."""
    orders = hot_orders(spark, sf_dir)
    return orders.select("order_id", tiering.archive_id_at(F.col("timestamp")).alias("archive_id"))


@query("archive_count")
def archive_count(spark, sf_dir):
    """Archives in the manifest after one run, and after a second one."""
    store, folder, database, _ = archived(spark, sf_dir, EARLIER_CUTOFF)
    first = tiering.archive_count(spark, database).first()["total_archives"]
    tiering.archive_old_orders(
        store, folder, CUTOFF, database, archive_id="archive_2", threshold_mb=0
    )
    return tiering.archive_count(spark, database).withColumn("after_first_run", F.lit(first))


@query("archive_catalog")
def archive_catalog(spark, sf_dir):
    """The table over one archive, asked by its catalog name."""
    _, _, database, _ = archived(spark, sf_dir)
    table = spark.table(f"{database}.archived_orders_archive_1")
    return kpis.order_summary(table)


@query("archive_remainder")
def archive_remainder(spark, sf_dir):
    store, _, _, _ = archived(spark, sf_dir)
    return _order_rows(store.orders())


@query("archive_report")
def archive_report(spark, sf_dir):
    return archived(spark, sf_dir)[3]


@query("archive_inventory")
def archive_inventory(spark, sf_dir):
    folder = work_dir(spark, "cold")
    orders = hot_orders(spark, sf_dir)
    tiering.write_archive(tiering.candidates(orders, EARLIER_CUTOFF), folder, "archive_1")
    tiering.write_archive(tiering.candidates(orders, CUTOFF), folder, "archive_2")
    found = health.archive_inventory(tiering.read_archives(spark, folder, orders.schema))
    return found.select(
        "total_archives", "total_records", (F.col("total_size_mb") > 0).alias("has_size")
    )


def nested_archive(spark: SparkSession, sf_dir: str) -> str:
    """An archive of nested events older than the cut-off; its own path."""
    folder = work_dir(spark, "cold")
    rows = views.event_rows(spark, sf_dir)
    old = rows.where(parse_iso("order.timestamp") < F.lit(CUTOFF).cast("timestamp"))
    tiering.write_archive(old, folder, "archive_1")
    return tiering.archive_path(folder, "archive_1")


@query("cold_total")
def cold_total(spark, sf_dir):
    return cold.total(cold.read_archive(spark, nested_archive(spark, sf_dir)))


@query("cold_total_sql")
def cold_total_sql(spark, sf_dir):
    return cold.total_sql(spark, nested_archive(spark, sf_dir))


@query("cold_category_df")
def cold_category_df(spark, sf_dir):
    return cold.category_revenue(cold.read_archive(spark, nested_archive(spark, sf_dir)))


@query("cold_category_sql")
def cold_category_sql(spark, sf_dir):
    return cold.category_revenue_sql(spark, nested_archive(spark, sf_dir))


@query("cold_category_flat")
def cold_category_flat(spark, sf_dir):
    _, folder, _, _ = archived(spark, sf_dir)
    rows = cold.read_archive(spark, tiering.archives_path(folder), "archive_1")
    products = views.prod(spark, sf_dir)
    keyed = products.withColumn("product_id", text.product_key(F.col("product_id")))
    return cold.category_revenue_flat(rows, keyed)


# -- serving ---------------------------------------------------------------------------


def refreshed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all result sets published."""
    serving = work_dir(spark, "serving")
    payments = views.pay(spark, sf_dir)
    refresh_plan.refresh(spark, serving, *views.star(spark, sf_dir), payments)
    return serving


@query("refresh_results")
def refresh_results(spark, sf_dir):
    """The summary, from the rolled-up cells of one pass."""
    cells = rollup.build_cells(spark, *views.star(spark, sf_dir))
    return refresh_plan.summary_of(cells)


@query("publish_kpis")
def publish_kpis(spark, sf_dir):
    """Each published result set with its rows and its summed revenue."""
    serving = refreshed(spark, sf_dir)
    parts = []
    for name in published_names(spark, serving):
        rows = read_published(spark, serving, name)
        has_revenue = "total_revenue" in rows.columns
        amount = F.col("total_revenue").cast("decimal(28,4)") if has_revenue else F.lit(None)
        total = F.sum(amount).cast("double")
        parts.append(
            rows.agg(
                F.lit(name).alias("name"),
                F.count(F.lit(1)).alias("row_count"),
                total.alias("revenue_total"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("refresh_guard")
def refresh_guard(spark, sf_dir):
    """A refresh of all orders by state, and one of none; what each has published."""
    orders, customers, products = views.star(spark, sf_dir)
    result = None
    for name, rows in {"all": orders, "none": orders.where("timestamp < '1900-01-01'")}.items():
        serving = work_dir(spark, "serving")
        done = refresh_plan.refresh(spark, serving, rows, customers, products)
        summary = read_published(spark, serving, "summary")
        count = F.lit(0).cast("long") if summary is None else F.col("total_orders")
        part = (spark.range(1) if summary is None else summary).select(
            F.lit(name).alias("orders"), F.lit(done).alias("published"), count.alias("total_orders")
        )
        result = part if result is None else result.unionByName(part)
    return result


@query("last_updated")
def last_updated(spark, sf_dir):
    """The categories with the time they were made, as it is published."""
    made = kpis.stamped(kpis.category_performance(joined(spark, sf_dir)), FRESH_AS_OF)
    return _plain_times(made, "last_updated")


@query("published_figures")
def published_figures(spark, sf_dir):
    """The figures that a refresh publishes beside its results."""
    folder = f"{refreshed(spark, sf_dir)}/figures"
    read = lambda name: read_published(spark, folder, name).drop("last_updated")
    last = read("revenue_last_30").agg(F.count(F.lit(1)).alias("shown_minutes"))
    one = lambda rows, name: rows.select(
        F.lit(name).alias("figure"), F.col(name).cast("double").alias("value")
    )
    return (
        one(read("orders_per_minute"), "orders_per_minute")
        .unionByName(one(read("avg_revenue_10min"), "avg_revenue"))
        .unionByName(one(read("order_value_against_base"), "percent_above_base"))
        .unionByName(one(read("revenue_velocity"), "latest_revenue"))
        .unionByName(one(last, "shown_minutes"))
    )


@query("published_count")
def count_published(spark, sf_dir):
    return published_count(spark, refreshed(spark, sf_dir))


@query("read_published")
def read_category_performance(spark, sf_dir):
    serving = refreshed(spark, sf_dir)
    return read_published(spark, serving, "category_performance").drop("last_updated")


@query("published_or_compute")
def summary_from_either(spark, sf_dir):
    """The summary before and after it is published, computed once."""
    serving = work_dir(spark, "serving")

    @cache
    def compute() -> DataFrame:
        return _kept(kpis.summary(joined(spark, sf_dir)), work_dir(spark, "summary"))

    first = published_or_compute(spark, serving, "summary", compute)
    publish(spark, serving, "summary", compute())
    return first.unionByName(published_or_compute(spark, serving, "summary", compute))


@query("state_category_head")
def state_category_head(spark, sf_dir):
    serving = refreshed(spark, sf_dir)
    return kpis.state_category_head(read_published(spark, serving, "state_category"))


# -- ingest ----------------------------------------------------------------------------


# The least and the greatest number of events in a file.
FILE_EVENTS = (1, 250_000)


def written_lines(lines: DataFrame, events: int, folder: str | None = None) -> str:
    """Event lines in files, packed, of some `events`; the folder.

    A packed file is read by one task, so its events are bounded. They are four files at
    least, and as the number is set by the writer, no row is shuffled for it. The lines repeat
    their names, so that the fastest packing leaves a twelfth.
    """
    folder = folder or work_dir(lines.sparkSession, "events")
    least, most = FILE_EVENTS
    in_file = min(max(-(-events // 4), least), most)
    writer = lines.write.mode("append").option("compression", "gzip")
    writer = writer.option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", in_file).text(folder)
    return folder


def event_files(spark: SparkSession, sf_dir: str, lines: DataFrame) -> dict[str, str]:
    """The lines as a source that hands out their files in two batches."""
    path = written_lines(lines, views.table(spark, sf_dir, "lineitem").count())
    count = len(spark.read.text(path).inputFiles())
    return {"kind": "files", "path": path, "maxFilesPerTrigger": str(max(-(-count // 2), 1))}


def ingested(
    spark: SparkSession, sf_dir: str, lines: DataFrame, refresh_to: str | None = None
) -> HotStore:
    """The hot tier after all lines have come in through the stream, in several batches."""
    events = read_events(spark, event_files(spark, sf_dir, lines))
    store = hot_store(spark)
    once = {"availableNow": True}
    if refresh_to is None:
        started = ingest.start_ingest(spark, events, store, once)
    else:
        started = figures.start_ingest_and_refresh(spark, events, store, refresh_to, once)
    started.awaitTermination()
    return store


@query("ingest_decode")
def ingest_decode(spark, sf_dir):
    source = event_files(spark, sf_dir, views.event_lines(spark, sf_dir))
    decoded = decode.decode(with_file_order(spark.read.text(source["path"])))
    return star.flatten_event(decode.nested_events(decoded))


def broken(lines: DataFrame) -> DataFrame:
    """The lines of some brands' products made bad, each brand's in another way."""
    brand = F.get_json_object("value", "$.product.brand")

    def spoiled(pattern: str, replacement: str) -> Column:
        return F.regexp_replace("value", pattern, replacement)

    value = (
        F.when(brand == "Brand#1", F.col("value").substr(F.lit(1), F.length("value") - 9))
        .when(brand == "Brand#2", spoiled('"payment":', '"paid":'))
        .when(brand == "Brand#3", spoiled('"quantity":[0-9]+', '"quantity":"many"'))
        .when(brand == "Brand#4", spoiled('"order_status"', '"state_of_order"'))
        .when(brand == "Brand#5", spoiled('"product_id":"(PROD_[0-9]+)","name"', '"name"'))
        .otherwise(F.col("value"))
    )
    return lines.select(value.alias("value"))


@query("ingest_dead_letter")
def ingest_dead_letter(spark, sf_dir):
    """Bad events by reason, and the orders that were kept."""
    store = ingested(spark, sf_dir, broken(views.event_lines(spark, sf_dir)))
    bad = store.dead_letters().groupBy("reason").agg(F.count(F.lit(1)).alias("events"))
    good = store.orders().agg(
        F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("events")
    )
    return bad.unionByName(good)


@query("stream_ingest_orders")
def stream_ingest_orders(spark, sf_dir):
    store = ingested(spark, sf_dir, views.event_lines(spark, sf_dir))
    return _plain_times(store.orders(), "timestamp")


@query("stream_replay")
def stream_replay(spark, sf_dir):
    """Orders of a stream that failed after writing its second batch and was started again."""
    source = event_files(spark, sf_dir, views.event_lines(spark, sf_dir))
    store = hot_store(spark)

    def lose_the_batch(_store: HotStore, batch_id: int) -> None:
        if batch_id == 1:
            raise OSError("lost after the write, before the checkpoint")

    for after in (lose_the_batch, None):
        events = read_events(spark, source)
        started = ingest.start_ingest(spark, events, store, {"availableNow": True}, after)
        try:
            started.awaitTermination()
        except StreamingQueryException:
            if after is None:
                raise
    return _order_rows(store.orders())


@query("stream_ingest_customers")
def stream_ingest_customers(spark, sf_dir):
    return ingested(spark, sf_dir, views.event_lines(spark, sf_dir)).customers()


@query("stream_publish_kpis")
def stream_publish_kpis(spark, sf_dir):
    serving = work_dir(spark, "serving")
    ingested(spark, sf_dir, views.event_lines(spark, sf_dir), serving)
    return read_published(spark, serving, "state_category").drop("last_updated")


@query("stream_revenue_by_minute")
def stream_revenue_by_minute(spark, sf_dir):
    """Running minutes over a stream of order files, then the latest 60."""
    folder = work_dir(spark, "orders")
    orders = views.minutes(spark, sf_dir)
    orders.repartition(4).write.parquet(folder)
    stream = (
        spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", "2").parquet(folder)
    )
    root = work_dir(spark, "minutes")
    running = figures.running_minutes(stream)
    figures.start_minutes(running, root, {"availableNow": True}).awaitTermination()
    return kpis.revenue_by_minute(figures.read_minutes(spark, root))


# -- upserts ---------------------------------------------------------------------------


def changes(
    spark: SparkSession, sf_dir: str, table: str, key: Column, fields: dict[str, Column]
) -> DataFrame:
    """A stream of changes made of the orders, through three batches.

    Every order changes the row of its key. The first field is always set; the second only
    by every third order, and to null by every ninth; the other fields never.
    """
    orders = views.fact(spark, sf_dir)
    number = F.col("order_id")
    always, sometimes = fields
    schema = schemas.EVENT[table[:-1]].dataType
    key_name = schemas.UPSERT_KEYS[table]
    columns = {
        key_name: key,
        always: fields[always],
        sometimes: F.when(number % 9 != 0, fields[sometimes]),
    }
    set_names = F.when(number % 3 == 0, F.array(*map(F.lit, [key_name, always, sometimes])))
    rows = orders.select(
        *[columns.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema],
        F.coalesce(set_names, F.array(F.lit(key_name), F.lit(always))).alias(PRESENT),
        number.alias("seq"),
        F.pmod(F.col("product_id"), F.lit(3)).alias("batch"),
    )
    times = {"registration_date": "date", "timestamp": "timestamp"}
    store = hot_store(spark)
    for batch in range(3):
        part = rows.where(F.col("batch") == batch).drop("batch")
        folded = fold(part, key_name, "seq")
        typed = folded.withColumns(
            {n: F.col(n).cast(t) for n, t in times.items() if n in folded.columns}
        )
        store.write_batch(batch, {table: typed})
    return getattr(store, table)().select(key_name, always, sometimes)


@query("upsert_customers")
def upsert_customers(spark, sf_dir):
    number = F.col("order_id")
    fields = {
        "name": F.concat(F.lit("name "), number.cast("string")),
        "state": F.concat(F.lit("state "), number.cast("string")),
    }
    return changes(spark, sf_dir, "customers", text.customer_key(F.col("customer_id")), fields)


@query("upsert_products")
def upsert_products(spark, sf_dir):
    number = F.col("order_id")
    fields = {
        "name": F.concat(F.lit("name "), number.cast("string")),
        "list_price": number.cast("double"),
    }
    return changes(spark, sf_dir, "products", text.product_key(F.col("product_id")), fields)


@query("upsert_payments")
def upsert_payments(spark, sf_dir):
    number = F.col("order_id")
    fields = {
        "payment_method": F.concat(F.lit("m"), (number % 4).cast("string")),
        "status": F.concat(F.lit("status "), number.cast("string")),
    }
    return changes(spark, sf_dir, "payments", text.payment_key(F.col("order_ref")), fields)
