"""Queries over archived orders.

An archive holds either flat orders or nested events (`order`, `customer`, `product`,
`payment`). Nested archives answer category questions alone; flat ones need the products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions.money import as_double, summed, ticks
from orderlens.operators.star import product_dim


def read_archive(spark: SparkSession, path: str, archive_id: str | None = None) -> DataFrame:
    """One archive by its own path, or by its id under the path of all archives."""
    archives = spark.read.parquet(path)
    return archives if archive_id is None else archives.where(F.col("archive_id") == archive_id)


def total(archive: DataFrame) -> DataFrame:
    return archive.agg(F.count(F.lit(1)).alias("total_archived_orders"))


def total_sql(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(f"SELECT count(*) AS total_archived_orders FROM parquet.`{path}`")


def category_revenue(archive: DataFrame) -> DataFrame:
    """Revenue and orders per category of a nested archive, largest revenue first."""
    return _by_category(archive, F.col("product.category"), ticks("`order`.total_amount"))


def category_revenue_flat(archive: DataFrame, products: DataFrame) -> DataFrame:
    """The same of a flat archive, with the products that orders name."""
    joined = archive.join(product_dim(products), "product_id", "inner")
    return _by_category(joined, F.col("product_category"), ticks("total_amount"))


def _by_category(df: DataFrame, category: Column, amount: Column) -> DataFrame:
    groups = df.groupBy(category.alias("category")).agg(
        summed(amount).alias("sum_revenue"), F.count(F.lit(1)).alias("order_count")
    )
    return groups.orderBy(F.desc("sum_revenue"), "category").select(
        "category", as_double(F.col("sum_revenue")).alias("total_revenue"), "order_count"
    )


def category_revenue_sql(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """Top categories of a nested archive, in SQL over its path."""
    return spark.sql(
        f"""
        SELECT category, order_count, CAST(sum_revenue AS DOUBLE) AS total_revenue
        FROM (
            SELECT product.category AS category,
                   count(*) AS order_count,
                   sum(CAST(`order`.total_amount AS DECIMAL(18, 4))) AS sum_revenue
            FROM parquet.`{path}`
            GROUP BY product.category
        )
        ORDER BY sum_revenue DESC, category
        LIMIT {int(k)}
        """
    )
