"""Scans of the four tables with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from orderlens import schemas


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table read with a given schema: no inference job, columns by name."""
    return spark.read.schema(schema).parquet(path)


def scan_orders(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.ORDERS)


def scan_customers(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.CUSTOMERS)


def scan_products(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.PRODUCTS)


def scan_payments(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.PAYMENTS)


def register_views(frames: dict[str, DataFrame]) -> None:
    """Frames as views by name, for SQL over them in the same session."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def has_rows(df: DataFrame) -> bool:
    """The guard before a refresh: reads one row at most."""
    return not df.isEmpty()
