"""One pass over the orders for all figures.

The KPI functions differ in grouping only. Their groups are unions of three kinds of cell:
orders of one customer in one category, orders of one product, orders of one minute. The
orders are joined and scanned once, summed into the three kinds at the same time, and every
figure is then computed from the cells. Cells are summed within each task before the
shuffle, so what is shuffled grows with customers, products and minutes and a hot customer
or product sends one row per task.

What a step leaves is written to the shared folder. It outlives a lost executor, dimensions
are folded out of their changes once, and each figure reads only the columns it needs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.functions.money import ticks
from orderlens.functions.times import minute
from orderlens.operators.star import customer_dim, product_dim
from orderlens.session import work_dir

CUSTOMER_CELL = "customer_category"
PRODUCT_CELL = "product"
MINUTE_CELL = "minute"

# A broadcast row of a key and a short text takes some 100 bytes: 100 MB at the most.
BROADCAST_ROWS = 1_000_000


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_known_key(
    orders: DataFrame, known: DataFrame, key: str, path: str, broadcast_rows: int
) -> DataFrame:
    """Orders whose `key` is among the `known` ones.

    Few known keys are broadcast. Many would mean shuffling all orders to find the few that
    have no match, so then those are looked for first: the distinct keys of the orders, of
    which only the unmatched are kept, and orders with such a key are taken out. What is
    shuffled is one row per key and task, however many orders a key has.
    """
    if known.count() <= broadcast_rows:
        return orders.join(F.broadcast(known), key, "left_semi")
    present = orders.select(key).where(F.col(key).isNotNull()).distinct()
    unmatched = _kept(present.join(known, key, "left_anti"), path)
    return orders.where(F.col(key).isNotNull()).join(unmatched, key, "left_anti")


def with_category(orders: DataFrame, products: DataFrame, broadcast_rows: int) -> DataFrame:
    """Orders with the category of their product; those without a product drop out."""
    categories = products.select("product_id", "product_category")
    if categories.count() <= broadcast_rows:
        categories = F.broadcast(categories)
    return orders.join(categories, "product_id")


def roll_up(lines: DataFrame) -> DataFrame:
    """Cells of the three kinds, from orders with their `product_category`."""
    amounts = lines.select(
        "customer_id",
        "product_id",
        "product_category",
        minute("timestamp").alias("minute_start"),
        ticks("total_amount").alias("amount"),
        "quantity",
    )
    # Which grouping columns a cell lacks tells its kind apart, also where a value is null.
    kind = (
        F.when(F.grouping("minute_start") == 0, MINUTE_CELL)
        .when(F.grouping("product_id") == 0, PRODUCT_CELL)
        .otherwise(CUSTOMER_CELL)
    )
    return amounts.groupingSets(
        [
            ["customer_id", "product_category"],
            ["product_id"],
            ["minute_start"],
        ],
        "customer_id",
        "product_category",
        "product_id",
        "minute_start",
    ).agg(
        kind.alias("kind"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("amount").alias("revenue"),
        F.sum("quantity").cast("long").alias("units"),
    )


@dataclass(frozen=True)
class Cells:
    """The written cells, and two of their kinds with the attributes their figures need."""

    all: DataFrame
    by_customer: DataFrame
    by_product: DataFrame

    @property
    def by_minute(self) -> DataFrame:
        return self.all.where(F.col("kind") == MINUTE_CELL)


def build_cells(
    spark: SparkSession,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    path: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Cells:
    """Run the pass, and keep its result under `path`.

    Only keys and categories are joined to orders. The other attributes are joined to the
    cells, once for all figures.
    """
    path = path or work_dir(spark, "cells")
    with ThreadPoolExecutor(max_workers=2) as pool:
        people, goods = pool.map(
            _kept,
            (customer_dim(customers).drop("customer_name"), product_dim(products)),
            (f"{path}/customers", f"{path}/products"),
        )
        ids = people.select("customer_id")
        matched = with_known_key(
            orders, ids, "customer_id", f"{path}/unmatched", broadcast_rows
        )
        cells = roll_up(with_category(matched, goods, broadcast_rows))
        cells.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/all")
        kept = spark.read.schema(cells.schema).parquet(f"{path}/all")

        def of(kind: str, *keys: str) -> DataFrame:
            rows = kept.where(F.col("kind") == kind)
            return rows.select(*keys, "n_orders", "revenue", "units")

        by_customer, by_product = pool.map(
            _kept,
            (
                of(CUSTOMER_CELL, "customer_id", "product_category").join(people, "customer_id"),
                of(PRODUCT_CELL, "product_id").join(goods, "product_id"),
            ),
            (f"{path}/by_customer", f"{path}/by_product"),
        )
    return Cells(kept, by_customer, by_product)
