"""Keys, labels and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def padded_key(prefix: str, number: Column, width: int) -> Column:
    """Prefix and a number from zero up, with zeros in front up to `width` digits."""
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    )


# Prefixes and widths of the keys.


def order_key(number: Column) -> Column:
    return padded_key("ORD_", number, 8)


def payment_key(number: Column) -> Column:
    return padded_key("PAY_", number, 8)


def customer_key(number: Column) -> Column:
    return padded_key("CUST_", number, 6)


def product_key(number: Column) -> Column:
    return padded_key("PROD_", number, 5)


def pair_label(left: str, right: str) -> Column:
    """`left - right`; null if either is, as a concatenation of both would be."""
    return F.concat(F.col(left), F.lit(" - "), F.col(right))


def shown_time(column: str | Column) -> Column:
    """The first 19 characters of a time's text: up to the second."""
    text = F.col(column) if isinstance(column, str) else column
    return F.substring(text.cast("string"), 1, 19)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, null fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
