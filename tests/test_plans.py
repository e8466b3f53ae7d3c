"""What the physical plans must and must not hold."""

import pytest
from frames import rows

from checks import queries, views
from checks.queries import QUERIES
from orderlens.operators import kpis, star
from orderlens.plans import rollup, tiering
from orderlens.sources.store import HotStore

LAZY = [
    name
    for name in sorted(QUERIES)
    if not name.startswith(
        ("archive_", "cold_", "stream_", "upsert_", "ingest_", "publish", "read_", "flow_", "refresh_", "state_category_head")
    )
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_product_in_the_core(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ExternalRDD"):
        assert node not in text, node


def test_flagship_reads_only_its_columns(spark, sf_dir):
    text = plan(QUERIES["revenue_state_category"](spark, sf_dir))
    assert (
        "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double,l_discount:double>"
        in text
    )
    assert "TakeOrderedAndProject" in text
    assert "partial_sum" in text


def test_bounds_reach_the_scan(spark, sf_dir, folder):
    store = HotStore(spark, folder)
    store.write_batch(0, {"orders": queries.hot_orders(spark, sf_dir)})
    text = plan(tiering.candidates(store.orders(), queries.CUTOFF))
    assert "LessThan(timestamp,1998-01-01" in text
    assert "PartitionFilters: [isnotnull(batch_id" in text
    rest = plan(tiering.remainder(store.orders(), queries.CUTOFF))
    assert "Or(GreaterThanOrEqual(timestamp,1998-01-01" in rest and "IsNull(timestamp))" in rest
    assert "GreaterThanOrEqual(ts," in plan(QUERIES["recent_order_rate"](spark, sf_dir))


def test_rollup_scans_the_orders_once_and_shuffles_sums(spark, sf_dir):
    orders, customers, products = views.star(spark, sf_dir)
    known = rollup.with_known_key(orders, customers.select("customer_id"), "customer_id", "", 10**6)
    goods = star.product_dim(products)
    text = plan(rollup.roll_up(rollup.with_category(known, goods, 10**6)))
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 1
    before_shuffle = text[text.index("Exchange hashpartitioning") :]
    assert "partial_sum" in before_shuffle


def test_many_customers_do_not_shuffle_the_orders(spark, sf_dir, folder):
    """Beyond the bound only distinct keys are shuffled; the orders lose the unmatched."""
    orders, customers, _ = views.star(spark, sf_dir)
    ids = customers.where("state != 'NATION_0'").select("customer_id")
    few = rollup.with_known_key(orders, ids, "customer_id", folder, 10**6)
    many = rollup.with_known_key(orders, ids, "customer_id", folder + "/unmatched", 0)
    assert "Exchange hashpartitioning" not in plan(many)
    assert sorted(rows(many.select("order_id"))) == sorted(rows(few.select("order_id")))
    assert 0 < many.count() < orders.count()
    unmatched = spark.read.parquet(folder + "/unmatched").count()
    assert unmatched == customers.where("state = 'NATION_0'").count()


def test_quality_report_is_one_pass(spark, sf_dir):
    text = plan(QUERIES["dq_report"](spark, sf_dir))
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 1


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_large_dimensions_are_not_broadcast(spark, sf_dir, no_broadcast):
    joined = star.orders_joined(*views.star(spark, sf_dir))
    assert "Broadcast" not in plan(joined)
    large = rows(kpis.revenue_by_state_category(joined))
    assert len(large) == 30


def test_results_do_not_depend_on_the_join_strategy(spark, sf_dir, no_broadcast):
    without = rows(kpis.revenue_by_state_category(queries.joined(spark, sf_dir)))
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "64m")
    assert rows(kpis.revenue_by_state_category(queries.joined(spark, sf_dir))) == without


def test_hot_keys_are_split_in_the_join(spark, no_broadcast):
    """One customer with a third of the orders, in tables too large to broadcast."""
    from pyspark.sql import functions as F

    n = 300_000
    customer = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.hash("id"), F.lit(5000)))
    orders = spark.range(0, n, 1, 16).select(
        F.col("id").alias("order_id"),
        customer.cast("long").alias("customer_id"),
        F.pmod(F.hash("id", F.lit(1)), F.lit(900)).cast("long").alias("product_id"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.lit(1).alias("quantity"),
        F.lit(1.0).alias("total_amount"),
    )
    customers = spark.range(5000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 50).cast("string").alias("state")
    )
    products = spark.range(900).select(
        F.col("id").alias("product_id"), (F.col("id") % 9).cast("string").alias("category")
    )
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        result = kpis.orders_by_state(star.orders_joined(orders, customers, products), 100)
        found = {r["state"]: r["order_count"] for r in result.collect()}
        assert "skew=true" in plan(result)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(found.values()) == n and found["7"] >= n // 3
