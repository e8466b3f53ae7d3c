"""The KPI refresh: all result sets from one pass, published by name."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.functions.money import cents, mean, summed
from orderlens.operators import kpis, minutes
from orderlens.plans.rollup import CUSTOMER_CELL, PRODUCT_CELL, Cells, build_cells
from orderlens.sources import files
from orderlens.sources.published import publish, read_published
from orderlens.sources.tables import has_rows

PARALLEL_RESULTS = 8


def summary_of(cells: Cells) -> DataFrame:
    """The summary from two kinds of cell, in one pass over them.

    A product has one cell, so its cells are counted; a customer has one per category.
    """
    of_customer = F.col("kind") == CUSTOMER_CELL
    totals = cells.all.where(F.col("kind").isin(CUSTOMER_CELL, PRODUCT_CELL)).agg(
        F.coalesce(F.sum(F.when(of_customer, F.col("n_orders"))), F.lit(0)).alias(
            "total_orders"
        ),
        summed(F.when(of_customer, F.col("revenue"))).alias("sum_revenue"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count("product_id").alias("unique_products"),
    )
    return totals.select(
        "total_orders",
        cents(F.coalesce(F.col("sum_revenue"), F.lit(0).cast("long"))).alias("total_revenue"),
        F.round(mean(F.col("sum_revenue"), F.col("total_orders")), 2).alias("avg_order_value"),
        "unique_customers",
        "unique_products",
    )


def results_of(cells: Cells, **state_category: object) -> dict[str, DataFrame]:
    """Every result set by the name it is published under."""
    return {
        "summary": summary_of(cells),
        "state_category": kpis.revenue_by_state_category(cells.by_customer, **state_category),
        "top_products": kpis.top_products(cells.by_product),
        "orders_by_state": kpis.orders_by_state(cells.by_customer),
        "category_performance": kpis.category_performance(cells.by_customer),
        "revenue_by_minute": kpis.revenue_by_minute(cells.by_minute),
        "segment_analysis": kpis.segment_analysis(cells.by_customer),
    }


def figures_of(recent: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's figures, from published results of at most 60 rows and of one."""
    return {
        "revenue_velocity": minutes.revenue_velocity(recent),
        "orders_per_minute": minutes.latest_order_rate(recent),
        "avg_revenue_10min": minutes.mean_recent_revenue(recent),
        "revenue_last_30": minutes.last_minutes(recent),
        "order_value_against_base": kpis.order_value_against_base(summary),
    }


def refresh(
    spark: SparkSession,
    serving: str,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    payments: DataFrame | None = None,
    version: int | None = None,
) -> bool:
    """Compute and publish all result sets; does nothing when there are no orders.

    The payment figures are published too where payments are given, and the figures per
    minute below `<serving>/figures`. The cells lie beside the results, which is a shared
    folder in any case, and go when all are published.
    """
    if not has_rows(orders):
        return False
    work = f"{serving}/_cells/{uuid.uuid4().hex}"
    try:
        cells = build_cells(spark, orders, customers, products, work)
        results = results_of(cells)
        if payments is not None:
            rows = payments.withColumnRenamed("status", "payment_status")
            results["payment_metrics"] = kpis.payment_metrics(rows)

        # Small independent jobs over the cells: run side by side, their fixed costs overlap.
        def put(folder: str, name: str, result: DataFrame) -> None:
            publish(spark, folder, name, kpis.stamped(result), version)

        with ThreadPoolExecutor(max_workers=PARALLEL_RESULTS) as pool:
            list(pool.map(lambda item: put(serving, *item), results.items()))
            recent = read_published(spark, serving, "revenue_by_minute")
            figures = figures_of(recent, read_published(spark, serving, "summary"))
            list(pool.map(lambda item: put(f"{serving}/figures", *item), figures.items()))
    finally:
        files.drop(spark, work)
    return True
