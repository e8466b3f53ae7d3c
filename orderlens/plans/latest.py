"""The latest minutes without reading all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.functions.times import AsOf, minute
from orderlens.operators.kpis import revenue_by_minute

# How far back to look, in minutes, before all orders are read.
REACHES = (240, 4_000, 64_000)


def latest_minutes(
    orders: DataFrame, k: int = 60, as_of: AsOf = None, reaches: tuple[int, ...] = REACHES
) -> DataFrame:
    """Revenue of the latest `k` minutes that have orders, latest first.

    Orders are read back to a bound, which reaches the scan. Every minute after the bound is
    whole, so if `k` of them have orders these are the latest; if not, the bound moves back,
    and at last there is none. `orders` may be joined: what counts is the rows that are left.
    """
    spark = orders.sparkSession
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    for reach in reaches:
        back = minute(now) - F.make_dt_interval(mins=F.lit(reach))
        text = F.date_format(back, "yyyy-MM-dd HH:mm:ss")
        since = spark.range(1).select(text.alias("since")).first()["since"]
        bound = F.lit(since).cast(orders.schema["timestamp"].dataType)
        rows = revenue_by_minute(orders.where(F.col("timestamp") >= bound), k)
        if rows.count() == k:
            return rows
    return revenue_by_minute(orders, k)
