"""The business figures.

Each function takes either joined orders or cells rolled up from them
(`orderlens.plans.rollup`): a cell stands for `n_orders` orders with their summed `revenue`
and `units`. Every figure is a count, an exact sum or a distinct count, so both inputs give
the same result. Aggregation is partial before each shuffle, and a distinct count is
shuffled by group and counted key together, so a hot group spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.functions.money import TICKS, as_double, cents, mean, percentage, summed, ticks
from orderlens.functions.text import pair_label
from orderlens.functions.times import AsOf, minute, minute_label
from orderlens.operators.star import UNKNOWN

# The shop's peak hours, the target share of payments in percent, and the
# order value that others are compared with.
PEAK_HOURS = (10, 11, 12, 18, 19, 20)
SUCCESS_TARGET = 95.0
ORDER_VALUE_BASE = 100.0


def order_count(df: DataFrame) -> Column:
    return F.sum("n_orders") if "n_orders" in df.columns else F.count(F.lit(1))


def revenue(df: DataFrame) -> Column:
    """Summed ticks."""
    return summed(F.col("revenue") if "revenue" in df.columns else ticks("total_amount"))


def units(df: DataFrame) -> Column:
    return F.sum("units" if "units" in df.columns else "quantity").cast("long")


def _top(df: DataFrame, measure: str, ties: list[str], k: int | None) -> DataFrame:
    """Largest measure first; equal measures in the order of the group's own keys."""
    ordered = df.orderBy(F.desc(measure), *ties)
    return ordered if k is None else ordered.limit(k)


def summary(df: DataFrame) -> DataFrame:
    """One row over joined orders; zeros and a null average when there are none."""
    totals = df.agg(
        F.coalesce(order_count(df), F.lit(0)).alias("total_orders"),
        revenue(df).alias("sum_revenue"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("product_id").alias("unique_products"),
    )
    return _rounded_summary(totals, "unique_customers", "unique_products")


def order_summary(orders: DataFrame) -> DataFrame:
    """The summary of unjoined orders: count, revenue, average."""
    totals = orders.agg(
        order_count(orders).alias("total_orders"), revenue(orders).alias("sum_revenue")
    )
    return _rounded_summary(totals)


def _rounded_summary(totals: DataFrame, *more: str) -> DataFrame:
    revenue_sum = F.coalesce(F.col("sum_revenue"), F.lit(0).cast("long"))
    average = mean(F.col("sum_revenue"), F.col("total_orders"))
    return totals.select(
        "total_orders",
        cents(revenue_sum).alias("total_revenue"),
        F.round(average, 2).alias("avg_order_value"),
        *more,
    )


def revenue_by_state_category(
    df: DataFrame,
    min_revenue: float = 50,
    k: int | None = 30,
    no_state: str = UNKNOWN,
    no_category: str = UNKNOWN,
) -> DataFrame:
    known = df.where(
        (F.col("customer_state") != no_state) & (F.col("product_category") != no_category)
    )
    groups = known.groupBy("customer_state", "product_category").agg(
        order_count(df).alias("order_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        revenue(df).alias("sum_revenue"),
    )
    kept = groups.where(F.col("sum_revenue") > F.lit(min_revenue * TICKS))
    return _top(kept, "sum_revenue", ["customer_state", "product_category"], k).select(
        "customer_state",
        "product_category",
        "order_count",
        "unique_customers",
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        mean(F.col("sum_revenue"), F.col("order_count")).alias("avg_order_value"),
    )


def top_products(df: DataFrame, k: int = 10, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Best sellers by units. `keys` are the columns that tell products apart."""
    keys = keys or ("product_name", "product_category", "product_brand")
    groups = df.groupBy(*keys).agg(
        units(df).alias("total_quantity"),
        revenue(df).alias("sum_revenue"),
        order_count(df).alias("order_count"),
    )
    return _top(groups, "total_quantity", list(keys), k).select(
        *keys,
        "total_quantity",
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        "order_count",
    )


def top_products_by_name(df: DataFrame, k: int = 10) -> DataFrame:
    """Best sellers without regard to brand, over the 15-column row."""
    return top_products(df, k, ("product_name", "category"))


def orders_by_state(
    df: DataFrame, k: int = 20, no_state: str | None = UNKNOWN
) -> DataFrame:
    known = df if no_state is None else df.where(F.col("customer_state") != no_state)
    groups = known.groupBy(F.col("customer_state").alias("state")).agg(
        order_count(df).alias("order_count"), revenue(df).alias("sum_revenue")
    )
    return _top(groups, "order_count", ["state"], k).select(
        "state",
        "order_count",
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        mean(F.col("sum_revenue"), F.col("order_count")).alias("avg_order_value"),
    )


def orders_by_state_all(df: DataFrame, k: int = 20) -> DataFrame:
    """Every state counts, and no average; over the 15-column row."""
    groups = df.groupBy("state").agg(
        order_count(df).alias("order_count"), revenue(df).alias("sum_revenue")
    )
    return _top(groups, "order_count", ["state"], k).select(
        "state", "order_count", as_double(F.col("sum_revenue")).alias("total_revenue")
    )


def category_performance(df: DataFrame) -> DataFrame:
    groups = df.groupBy(F.col("product_category").alias("category")).agg(
        order_count(df).alias("order_count"),
        revenue(df).alias("sum_revenue"),
        units(df).alias("total_quantity"),
    )
    return _top(groups, "sum_revenue", ["category"], None).select(
        "category",
        "order_count",
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        "total_quantity",
    )


def segment_analysis(df: DataFrame, segment: str = "customer_segment") -> DataFrame:
    groups = df.groupBy(F.col(segment).alias("segment")).agg(
        F.count_distinct("customer_id").alias("unique_customers"),
        order_count(df).alias("total_orders"),
        revenue(df).alias("sum_revenue"),
    )
    return groups.select(
        "segment",
        "unique_customers",
        "total_orders",
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        mean(F.col("sum_revenue"), F.col("total_orders")).alias("avg_order_value"),
    )


def payment_metrics(df: DataFrame) -> DataFrame:
    """Count and mean processing time per method and status.

    Times are summed to 12 decimals of a second, in any order; one that is not a number is
    left out of the mean.
    """
    time = F.col("processing_time").try_cast("decimal(28,12)")
    groups = df.groupBy("payment_method", "payment_status").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(time).alias("sum_time"),
        F.count(time).alias("timed"),
    )
    return groups.select(
        "payment_method",
        "payment_status",
        "count",
        F.try_divide(F.col("sum_time").cast("double"), F.col("timed").cast("double")).alias(
            "avg_processing_time"
        ),
    )


def payment_success_rate(payments: DataFrame, target: float = SUCCESS_TARGET) -> DataFrame:
    """Share of successful payments in percent, and whether it reaches the target."""
    counts = payments.agg(
        F.count(F.lit(1)).alias("total_payments"),
        F.count_if(F.col("status") == "success").alias("success_payments"),
    )
    rate = F.round(percentage(F.col("success_payments"), F.col("total_payments")), 2)
    return counts.select(
        "total_payments",
        "success_payments",
        rate.alias("payment_success_rate"),
        (rate >= target).alias("target_met"),
    )


def order_value_against_base(
    summary_row: DataFrame, base: float = ORDER_VALUE_BASE
) -> DataFrame:
    """Average order value against a fixed base, in percent; null without a value."""
    value = F.col("avg_order_value")
    change = (value - base) / base * 100
    return summary_row.select(
        value, F.when(value > 0, change).alias("percent_above_base")
    )


def revenue_by_minute(df: DataFrame, k: int = 60) -> DataFrame:
    """Revenue of the latest `k` minutes that have orders, latest first.

    Minutes are grouped as numbers; only the rows shown get a text label.
    """
    start = F.col("minute_start") if "minute_start" in df.columns else minute("timestamp")
    groups = df.groupBy(start.alias("start")).agg(
        revenue(df).alias("sum_revenue"), order_count(df).alias("order_count")
    )
    latest = groups.orderBy(F.desc("start")).limit(k)
    return latest.select(
        minute_label("start").alias("minute"),
        as_double(F.col("sum_revenue")).alias("total_revenue"),
        "order_count",
    )


def orders_by_peak_hour(df: DataFrame, hours: tuple[int, ...] = PEAK_HOURS) -> DataFrame:
    """Orders inside and outside the shop's peak hours."""
    peak = F.hour("timestamp").isin(*hours)
    return df.groupBy(peak.alias("is_peak")).agg(
        F.count(F.lit(1)).alias("order_count"),
        as_double(revenue(df)).alias("total_revenue"),
    )


def state_category_head(published: DataFrame, k: int = 15) -> DataFrame:
    """The first rows of the published state and category result, with one label."""
    label = pair_label("customer_state", "product_category")
    return (
        published.orderBy(F.desc("total_revenue"), "customer_state", "product_category")
        .limit(k)
        .select(label.alias("state_category"), "total_revenue")
    )


def stamped(df: DataFrame, as_of: AsOf = None) -> DataFrame:
    """With the time the result was made."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    return df.withColumn("last_updated", now)
