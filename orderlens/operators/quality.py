"""Data-quality checks over the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.functions.times import AsOf, age_minutes, moment

# Fixed value.
STALE_AFTER_MINUTES = 5


def duplicates(orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Ids that occur more than once; missing ids count as one id."""
    per_id = orders.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.count_if(F.col("n") > 1).alias("duplicate_count"))


def nulls(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count_if(F.col("order_id").isNull()).alias("null_orders"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customers"),
    )


def invalid_amounts(orders: DataFrame) -> DataFrame:
    """Amounts of zero or less. NaN is not among them: Spark takes it as the greatest."""
    return orders.agg(F.count_if(F.col("total_amount") <= 0).alias("invalid_amounts"))


def freshness(
    orders: DataFrame, as_of: AsOf = None, stale_after: float = STALE_AFTER_MINUTES
) -> DataFrame:
    """Age of the latest order, and whether that is too old."""
    now = moment(orders, "timestamp", as_of)
    latest = orders.agg(F.max("timestamp").alias("latest_order"))
    age = age_minutes(F.col("latest_order"), now)
    return latest.select(
        "latest_order", age.alias("age_minutes"), (age > stale_after).alias("is_stale")
    )


def volume(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total_orders"))


def report(
    orders: DataFrame, as_of: AsOf = None, stale_after: float = STALE_AFTER_MINUTES
) -> DataFrame:
    """All checks in one row, from a single pass.

    The duplicate check has to bring equal ids together anyway, so the other counts travel
    with it, already summed per id and task.
    """
    now = moment(orders, "timestamp", as_of)
    per_id = orders.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("customer_id").isNull()).alias("no_customer"),
        F.count_if(F.col("total_amount") <= 0).alias("bad_amount"),
        F.max("timestamp").alias("latest"),
    )

    def summed(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    counts = per_id.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_count"),
        summed(F.when(F.col("order_id").isNull(), F.col("n"))).alias("null_orders"),
        summed(F.col("no_customer")).alias("null_customers"),
        summed(F.col("bad_amount")).alias("invalid_amounts"),
        summed(F.col("n")).alias("total_orders"),
        F.max("latest").alias("latest"),
    )
    found = [
        F.col("duplicate_count") > 0,
        F.col("null_orders") > 0,
        F.col("null_customers") > 0,
        F.col("invalid_amounts") > 0,
        F.coalesce(age_minutes(F.col("latest"), now) > stale_after, F.lit(False)),
    ]
    issues = sum((flag.cast("int") for flag in found[1:]), found[0].cast("int"))
    return counts.select(
        "duplicate_count",
        "null_orders",
        "null_customers",
        "invalid_amounts",
        "total_orders",
        issues.alias("issues_count"),
        now.alias("last_check"),
    )
