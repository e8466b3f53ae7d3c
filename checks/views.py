"""The test tables read as orders, customers, products and payments.

One order line stands for one order. Payments and per-minute figures come from the events
table, because order dates have no time of day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions import text
from orderlens.sources.tables import scan

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what their amounts are made of. It takes less room than the amounts."""
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*names, "l_discount", "l_tax")


def line_columns() -> dict[str, Column]:
    """What an order takes from its line. `order_ref` is the key that payments name."""
    # Price in cents times what is left of the price in percent is the total in 1/10000.
    price = F.rint(F.col("l_extendedprice") * 100).cast("long")
    left = 100 - F.rint(F.col("l_discount") * 100).cast("long")
    total = (price * left) / F.lit(10000.0)
    # Times the tax in percent it is the tax in 1/1000000, rounded to 1/10000.
    tax_share = F.rint(F.col("l_tax") * 100).cast("long")
    tax = F.floor((price * left * tax_share + 50) / 100) / F.lit(10000.0)
    return {
        "order_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "order_ref": F.col("l_orderkey"),
        "product_id": F.col("l_partkey"),
        "quantity": F.col("l_quantity").cast("bigint"),
        "total_amount": total,
        "shipping_cost": F.lit(0.0),
        "tax_amount": tax,
    }


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all lines of an order share, one row per `order_ref`."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_ref"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderstatus").alias("order_status"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without what they share with others of their head."""
    own = line_columns()
    # Whole 1/10000 as decimals: they take less room in a shuffle than doubles do.
    exact = {n: own[n].cast("decimal(18,4)") for n in ("total_amount", "tax_amount")}
    return raw_lines(spark, sf_dir).select(*[c.alias(n) for n, c in (own | exact).items()])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: one per line."""
    lines, own = raw_lines(spark, sf_dir), line_columns()
    shared = heads(spark, sf_dir).withColumnRenamed("order_ref", "head_ref")
    rows = lines.join(shared, F.col("l_orderkey") == F.col("head_ref"))
    columns = own | {n: F.col(n) for n in ("customer_id", "timestamp", "order_status")}
    order = "order_id order_ref customer_id product_id timestamp quantity total_amount"
    order += " shipping_cost tax_amount order_status"
    return rows.select(*[columns[n].alias(n) for n in order.split()])


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    people = table(spark, sf_dir, "customer")
    return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("segment"),
    )


def prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("list_price"),
    )


def pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("payment_id"),
        F.col("event_id").alias("order_id"),
        F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("payment_method"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("value").alias("processing_time"),
        F.col("ts").alias("timestamp"),
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("total_amount"),
        F.lit(1).cast("bigint").alias("quantity"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some customers missing and some amounts negative."""
    orders = fact(spark, sf_dir)
    amount = F.col("total_amount")
    return orders.withColumns(
        {
            "customer_id": F.when(F.col("order_id") % 97 != 0, F.col("customer_id")),
            "total_amount": F.when(F.col("order_id") % 89 == 0, -amount).otherwise(amount),
        }
    )


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fact(spark, sf_dir), cust(spark, sf_dir), prod(spark, sf_dir)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events, one per order, with keys as padded text and ISO times.

    The payment is the one of the order's head; an order whose head has no event gets a
    payment of its own, which succeeded at once.
    """
    customers = cust(spark, sf_dir).withColumnsRenamed({"name": "c_name"})
    products = prod(spark, sf_dir).withColumnsRenamed({"name": "p_name"})
    payments = pay(spark, sf_dir).select(
        F.col("order_id").alias("order_ref"),
        F.col("payment_method").alias("pay_method"),
        F.col("status").alias("pay_status"),
        F.col("processing_time").alias("pay_time"),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    # Customers and payments are joined to the heads, which are fewer than the lines, and
    # products to the lines while these are narrow: a line is shuffled twice, not four times.
    shared = heads(spark, sf_dir).join(customers, "customer_id").join(payments, "order_ref", "left")
    own = {n: column for n, column in line_columns().items() if n not in ("order_ref", "product_id")}
    rows = (
        raw_lines(spark, sf_dir)
        .withColumnsRenamed({"l_orderkey": "order_ref", "l_partkey": "product_id"})
        .join(products, "product_id")
        .join(shared, "order_ref")
        .withColumns({"l_orderkey": F.col("order_ref")})
        .withColumns(own)
    )
    order_key = text.order_key(F.col("order_id"))
    customer_key = text.customer_key(F.col("customer_id"))
    product_key = text.product_key(F.col("product_id"))
    when = F.date_format("timestamp", iso)
    double = {n: F.col(n).cast("double") for n in ("total_amount", "tax_amount")}
    return rows.select(
        F.struct(
            order_key.alias("order_id"),
            customer_key.alias("customer_id"),
            product_key.alias("product_id"),
            when.alias("timestamp"),
            F.col("quantity").cast("int").alias("quantity"),
            F.col("list_price").alias("unit_price"),
            double["total_amount"].alias("total_amount"),
            F.lit(2.99).alias("shipping_cost"),
            double["tax_amount"].alias("tax_amount"),
            F.col("order_status"),
        ).alias("order"),
        F.struct(
            customer_key.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.lit("Springfield").alias("city"),
            F.col("state"),
            F.lit("USA").alias("country"),
            F.lit("2023-01-01").alias("registration_date"),
            F.col("segment"),
        ).alias("customer"),
        F.struct(
            product_key.alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("category"),
            F.concat("category", F.lit("_Sub_1")).alias("subcategory"),
            F.col("brand"),
            F.col("list_price").alias("cost_price"),
            F.col("list_price"),
        ).alias("product"),
        F.struct(
            text.payment_key(F.col("order_id")).alias("payment_id"),
            order_key.alias("order_id"),
            F.coalesce("pay_method", F.lit("m0")).alias("payment_method"),
            F.coalesce("pay_status", F.lit("success")).alias("status"),
            F.coalesce("pay_time", F.lit(0.0)).alias("processing_time"),
            when.alias("timestamp"),
        ).alias("payment"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested events as JSON text."""
    return text.json_rows(event_rows(spark, sf_dir))
