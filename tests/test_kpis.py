import datetime as dt

import frames
import pytest
from frames import at, rows
from pyspark.sql import functions as F

from orderlens.functions.money import exact, summed, ticks
from orderlens.operators import kpis, minutes, pricing, star
from orderlens.plans import refresh, rollup


@pytest.fixture(scope="module")
def joined(spark):
    return star.orders_joined(*frames.star(spark))


def test_join_is_inner_and_has_defaults(joined):
    found = {r["order_id"]: r for r in joined.collect()}
    assert sorted(found) == ["o1", "o2", "o3", "o4"]
    assert found["o3"]["customer_state"] == "Unknown"
    assert found["o3"]["customer_name"] == "Unknown"
    assert found["o3"]["customer_segment"] == "Regular"
    assert found["o2"]["product_category"] == "Unknown"
    assert found["o4"]["customer_city"] == "Unknown"


def test_missing_column_gets_default(spark):
    dim = star.customer_dim(spark.createDataFrame([("c1",)], "customer_id string"))
    assert rows(dim) == [("c1", "Unknown", "Unknown", "Regular", "Unknown")]


def test_join_coverage(spark):
    assert rows(star.join_coverage(*frames.star(spark))) == [(7, 4, 2, 1)]


def test_join_coverage_of_nothing(spark):
    orders, customers, products = frames.star(spark)
    assert rows(star.join_coverage(orders.limit(0), customers, products)) == [(0, 0, 0, 0)]


def test_summary(joined):
    assert rows(kpis.summary(joined)) == [(4, 157.29, 39.32, 3, 2)]


def test_summary_of_nothing(joined):
    assert rows(kpis.summary(joined.limit(0))) == [(0, 0.0, None, 0, 0)]


def test_sums_do_not_depend_on_order(spark):
    many = spark.range(0, 10000, 1, 7).select(
        F.lit("c").alias("customer_id"), F.lit("p").alias("product_id"), F.lit(0.1).alias("total_amount")
    )
    assert kpis.order_summary(many).first()["total_revenue"] == 1000.0


def test_state_category_filters_and_having(joined):
    found = rows(kpis.revenue_by_state_category(joined))
    # o3 has no state, o2 no category, o4 is below the least revenue.
    assert found == [("Ohio", "Home", 1, 1, 100.1, 100.1)]
    assert rows(kpis.revenue_by_state_category(joined, min_revenue=100.1)) == []
    assert len(rows(kpis.revenue_by_state_category(joined, min_revenue=0))) == 2


def test_ties_are_broken_by_keys(spark):
    orders, customers, products = frames.star(spark)
    same = orders.withColumns({"quantity": F.lit(1), "total_amount": F.lit(1.0)})
    j = star.orders_joined(same, customers, products)
    assert [r[0] for r in rows(kpis.orders_by_state(j, no_state=None))] == ["Ohio", "Iowa", "Unknown"]
    assert [r[0] for r in rows(kpis.top_products(j))] == ["Lamp", "Book"]


def test_top_products_by_units(joined):
    assert rows(kpis.top_products(joined, 1)) == [("Lamp", "Home", "Lux", 8, 157.09, 3)]


def test_minutes_keep_orders_without_time_last(joined):
    found = rows(kpis.revenue_by_minute(joined))
    assert found == [
        ("2024-01-01T10:01", 49.99, 1),
        ("2024-01-01T10:00", 100.3, 2),
        (None, 7.0, 1),
    ]
    assert len(rows(kpis.revenue_by_minute(joined, 1))) == 1


def minute_frame(spark, values):
    return spark.createDataFrame(values, "minute string, total_revenue double, order_count bigint")


def test_velocity(spark):
    def change(values):
        return minutes.revenue_velocity(minute_frame(spark, values)).first()["velocity_pct"]

    assert change([("10:00", 50.0, 1), ("10:01", 75.0, 1), ("09:00", 1.0, 1)]) == 50.0
    assert change([("10:00", 0.0, 1), ("10:01", 75.0, 1)]) == 0.0
    assert change([("10:00", -5.0, 1), ("10:01", 75.0, 1)]) == 0.0
    assert change([("10:00", 5.0, 1)]) is None


def test_recent_mean_divides_by_rows_present(spark):
    few = minute_frame(spark, [("10:00", 1.0, 1), ("10:01", 2.0, 1)])
    assert rows(minutes.mean_recent_revenue(few)) == [(2, 1.5)]
    assert rows(minutes.mean_recent_revenue(few, 1)) == [(1, 2.0)]
    assert rows(minutes.mean_recent_revenue(few.limit(0))) == [(0, None)]


def test_last_minutes_ascend(spark):
    some = minute_frame(spark, [("10:02", 1.0, 1), ("10:00", 1.0, 1), ("10:01", 2.0, 1)])
    assert [r[0] for r in rows(minutes.last_minutes(some, 2))] == ["10:01", "10:02"]


def test_payment_success_rate(spark):
    def rate(values):
        return rows(kpis.payment_success_rate(spark.createDataFrame(values, "status string")))

    assert rate([("success",)] * 19 + [("failed",)]) == [(20, 19, 95.0, True)]
    assert rate([("success",)] * 2 + [("failed",)]) == [(3, 2, 66.67, False)]
    assert rate([]) == [(0, 0, 0.0, False)]


def test_payment_metrics_average_over_timed(spark):
    df = spark.createDataFrame(
        [("card", "success", 1.0), ("card", "success", None), ("card", "failed", 3.0)],
        "payment_method string, payment_status string, processing_time double",
    )
    assert sorted(rows(kpis.payment_metrics(df))) == [
        ("card", "failed", 1, 3.0),
        ("card", "success", 2, 1.0),
    ]


def test_order_value_against_base(spark):
    def change(value):
        frame = spark.createDataFrame([(value,)], "avg_order_value double")
        return kpis.order_value_against_base(frame).first()["percent_above_base"]

    assert change(150.0) == 50.0
    assert change(0.0) is None
    assert change(None) is None


def test_peak_hours(spark):
    times = [(dt.datetime(2024, 1, 1, h), 1.0) for h in (9, 10, 12, 13, 18, 20, 21)]
    df = spark.createDataFrame(times, "timestamp timestamp, total_amount double")
    assert sorted(rows(kpis.orders_by_peak_hour(df))) == [(False, 3, 3.0), (True, 4, 4.0)]


def test_order_measures(spark):
    df = spark.createDataFrame(
        [(10.0, 0.5, 3, 0.08, 1.0), (10.0, 1.5, 3, 0.08, 1.006), (9.99, 0.95, 2, 0.08, 0.0)],
        "list_price double, discount_factor double, quantity int, tax_rate double,"
        " shipping_extra double",
    )
    found = pricing.derive_order_measures(df).select(
        *[F.col(c).cast("double") for c in ("unit_price", "total_amount", "tax_amount", "shipping_cost")]
    )
    assert rows(found) == [
        (7.0, 21.0, 1.68, 3.99),
        (10.0, 30.0, 2.4, 4.0),
        (9.49, 18.98, 1.52, 2.99),
    ]


def test_stamp(spark):
    stamped = kpis.stamped(spark.range(1), "2024-01-01 00:00:00")
    assert stamped.first()["last_updated"] == dt.datetime(2024, 1, 1)
    assert kpis.stamped(spark.range(1)).first()["last_updated"] is not None


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_cells_give_the_direct_results(spark, joined, folder, broadcast_rows):
    cells = rollup.build_cells(spark, *frames.star(spark), folder + "/cells", broadcast_rows)
    results = refresh.results_of(cells, min_revenue=0)
    direct = {
        "summary": kpis.summary(joined),
        "state_category": kpis.revenue_by_state_category(joined, min_revenue=0),
        "top_products": kpis.top_products(joined),
        "orders_by_state": kpis.orders_by_state(joined),
        "category_performance": kpis.category_performance(joined),
        "revenue_by_minute": kpis.revenue_by_minute(joined),
        "segment_analysis": kpis.segment_analysis(joined),
    }
    assert set(results) == set(direct)
    for name, result in results.items():
        assert result.columns == direct[name].columns, name
        assert sorted(rows(result), key=repr) == sorted(rows(direct[name]), key=repr), name


def test_cells_of_whole_tables_give_the_direct_results(spark, sf_dir, folder):
    from checks import queries, views

    joined = queries.joined(spark, sf_dir)
    cells = rollup.build_cells(spark, *views.star(spark, sf_dir), folder + "/cells")
    results = refresh.results_of(cells)
    assert rows(results["summary"]) == rows(kpis.summary(joined))
    assert rows(results["top_products"]) == rows(kpis.top_products(joined))
    assert rows(results["orders_by_state"]) == rows(kpis.orders_by_state(joined))
    assert rows(results["revenue_by_minute"]) == rows(kpis.revenue_by_minute(joined))


def test_latest_minutes_widen_until_there_are_enough(spark, joined):
    from orderlens.plans.latest import latest_minutes

    def found(k, as_of, reaches):
        return rows(latest_minutes(joined, k, as_of, reaches))

    every = rows(kpis.revenue_by_minute(joined))
    # One minute back holds one minute with orders, two hours back both.
    assert found(1, "2024-01-01 10:02:30", (1, 120)) == every[:1]
    assert found(2, "2024-01-01 10:02:30", (1, 120)) == every[:2]
    # Too few within any reach: all orders count, also those without a time.
    assert found(60, "2024-01-01 10:02:30", (1, 120)) == every
    assert found(2, "2030-01-01 00:00:00", (1, 120)) == every[:2]


def test_latest_minutes_bound_reaches_the_scan(spark, sf_dir):
    from checks import views
    from orderlens.plans.latest import latest_minutes

    minutes_of = latest_minutes(views.minutes(spark, sf_dir), 5, "2024-01-30 23:59:00")
    text = minutes_of._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-" in text


def test_measures_take_factors_whole(spark):
    df = spark.createDataFrame(
        [(1999.99, 0.87654321, 1, 0.08123456, 0.0)],
        "list_price double, discount_factor double, quantity int, tax_rate double,"
        " shipping_extra double",
    )
    found = pricing.derive_order_measures(df).select(
        F.col("unit_price").cast("double"), F.col("tax_amount").cast("double")
    )
    assert rows(found) == [(1753.08, 142.41)]


def test_small_times_are_not_cut(spark):
    df = spark.createDataFrame(
        [("card", "ok", 0.00004), ("card", "ok", 0.00002), ("card", "ok", float("nan"))],
        "payment_method string, payment_status string, processing_time double",
    )
    assert rows(kpis.payment_metrics(df)) == [("card", "ok", 3, 0.00003)]


def test_join_coverage_with_repeated_dimension_keys(spark):
    orders, customers, products = frames.star(spark)
    twice = star.join_coverage(orders, customers.union(customers), products.union(products))
    assert rows(twice) == [(7, 4, 2, 1)]


def test_totals_beyond_a_long_and_below_zero(spark):
    amounts = [(n, 9e13 if n % 4 else -1.5) for n in range(200)]
    df = spark.createDataFrame(amounts, "id int, total_amount double")
    found = df.agg(exact(summed(ticks("total_amount"))).alias("total")).first()["total"]
    assert found == 150 * 90_000_000_000_000 - 75
    nothing = df.limit(0).agg(exact(summed(ticks("total_amount"))).alias("total")).first()
    assert nothing["total"] is None
