"""Figures that compare neighbouring minutes.

Input is the published revenue per minute: at most 60 rows, labels in time order as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.functions.money import percent_change


def _latest(minutes: DataFrame, k: int) -> DataFrame:
    return minutes.orderBy(F.desc("minute")).limit(k)


def revenue_velocity(minutes: DataFrame) -> DataFrame:
    """Change of the latest minute against the one before it, in percent.

    0 if the earlier minute is not positive, null if there is no earlier minute.
    """
    pair = _latest(minutes, 2).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("minute").alias("minute"),
        F.max_by("total_revenue", "minute").alias("latest_revenue"),
        F.min_by("total_revenue", "minute").alias("earlier"),
    )
    previous = F.when(F.col("n") == 2, F.col("earlier"))
    return pair.select(
        "minute",
        "latest_revenue",
        previous.alias("previous_revenue"),
        percent_change(F.col("latest_revenue"), previous).alias("velocity_pct"),
    )


def latest_order_rate(minutes: DataFrame) -> DataFrame:
    """Orders in the latest minute."""
    return minutes.agg(
        F.max("minute").alias("minute"),
        F.max_by("order_count", "minute").alias("orders_per_minute"),
    )


def mean_recent_revenue(minutes: DataFrame, k: int = 10) -> DataFrame:
    """Mean revenue of the latest `k` minutes, divided by the minutes there are."""
    total = F.sum(F.col("total_revenue").cast("decimal(28,4)")).cast("double")
    count = F.count(F.lit(1))
    return _latest(minutes, k).agg(
        count.alias("minutes"),
        F.try_divide(total, count.cast("double")).alias("avg_revenue"),
    )


def last_minutes(minutes: DataFrame, k: int = 30) -> DataFrame:
    """The latest `k` minutes, earliest first."""
    return _latest(minutes, k).orderBy("minute")
