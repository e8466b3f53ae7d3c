"""Small literal frames."""

from __future__ import annotations

import datetime as dt

ORDER = "order_id string, customer_id string, product_id string, timestamp timestamp,"
ORDER += " quantity int, total_amount double"


def at(minute: int, second: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 10, minute, second)


def orders(spark, rows):
    return spark.createDataFrame(rows, ORDER)


def customers(spark, rows):
    return spark.createDataFrame(
        rows, "customer_id string, name string, state string, segment string, city string"
    )


def products(spark, rows):
    return spark.createDataFrame(
        rows, "product_id string, name string, category string, brand string"
    )


def star(spark):
    """Four joinable orders, one without a customer, one without a product."""
    return (
        orders(
            spark,
            [
                ("o1", "c1", "p1", at(0), 2, 100.10),
                ("o2", "c1", "p2", at(0, 30), 1, 0.20),
                ("o3", "c2", "p1", at(1), 5, 49.99),
                ("o4", "c3", "p1", None, 1, 7.0),
                ("o5", "nobody", "p1", at(2), 9, 1000.0),
                ("o6", "c1", "nothing", at(3), 9, 1000.0),
                ("o7", None, "p1", at(3), 9, 1000.0),
            ],
        ),
        customers(
            spark,
            [
                ("c1", "Ann", "Ohio", "Premium", "Dayton"),
                ("c2", None, None, None, None),
                ("c3", "Cy", "Iowa", "Budget", None),
            ],
        ),
        products(
            spark, [("p1", "Lamp", "Home", "Lux"), ("p2", "Book", None, None), ("p3", "x", "y", "z")]
        ),
    )


def rows(df):
    return [tuple(row) for row in df.collect()]
