"""Amounts of an order from its list price."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.functions.money import clamp

# Least and greatest discount factor, and the base shipping fee.
LOWEST_FACTOR = "0.7"
HIGHEST_FACTOR = "1.0"
SHIPPING_BASE = "2.99"


# Factors, rates and fees are kept to 14 decimals, prices to 8: products stay exact within the
# 38 digits of a decimal, and only results are rounded.
PRICE = "decimal(22,8)"
FEE = "decimal(28,14)"
FACTOR = "decimal(15,14)"
RATE = "decimal(17,14)"


def derive_order_measures(df: DataFrame) -> DataFrame:
    """Unit price, total, tax and shipping from `list_price`, `discount_factor`,
    `quantity`, `tax_rate` and `shipping_extra`, each rounded to cents."""
    factor = clamp(
        F.col("discount_factor").cast(FEE),
        F.lit(LOWEST_FACTOR).cast(FEE),
        F.lit(HIGHEST_FACTOR).cast(FEE),
    ).cast(FACTOR)
    cents = "decimal(18,2)"
    unit_price = F.round(F.col("list_price").cast(PRICE) * factor, 2).cast(cents)
    priced = df.withColumn("unit_price", unit_price)
    total = F.round(F.col("unit_price") * F.col("quantity").cast("decimal(10,0)"), 2)
    totalled = priced.withColumn("total_amount", total.cast(cents))
    return totalled.withColumn(
        "tax_amount",
        F.round(F.col("total_amount") * F.col("tax_rate").cast(RATE), 2).cast(cents),
    ).withColumn(
        "shipping_cost",
        F.round(F.col("shipping_extra").cast(FEE) + F.lit(SHIPPING_BASE).cast(FEE), 2).cast(cents),
    )
