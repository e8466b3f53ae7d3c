"""The star join and the shapes derived from it.

No join carries a hint. Catalyst broadcasts a dimension while its pruned size is below the
session's threshold and sorts and merges beyond it, where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What stands for a missing dimension field, and for a missing segment.
UNKNOWN = "Unknown"
REGULAR = "Regular"


def _or_default(df: DataFrame, name: str, default: str) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name), F.lit(default))


def customer_dim(customers: DataFrame) -> DataFrame:
    """Customers with defaults for what is missing: `Unknown`, and `Regular` as segment."""
    return customers.select(
        "customer_id",
        _or_default(customers, "name", UNKNOWN).alias("customer_name"),
        _or_default(customers, "state", UNKNOWN).alias("customer_state"),
        _or_default(customers, "segment", REGULAR).alias("customer_segment"),
        _or_default(customers, "city", UNKNOWN).alias("customer_city"),
    )


def product_dim(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        _or_default(products, "name", UNKNOWN).alias("product_name"),
        _or_default(products, "category", UNKNOWN).alias("product_category"),
        _or_default(products, "brand", UNKNOWN).alias("product_brand"),
    )


def join_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer; an order without one drops out."""
    return orders.join(customer_dim(customers), "customer_id", "inner")


def join_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    return orders.join(product_dim(products), "product_id", "inner")


def orders_joined(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The denormalised view: one row per order that has a customer and a product."""
    star = join_products(join_customers(orders, customers), products)
    return star.select(
        "order_id",
        "timestamp",
        "total_amount",
        "quantity",
        "customer_id",
        "customer_name",
        "customer_state",
        "customer_segment",
        "customer_city",
        "product_id",
        "product_name",
        "product_category",
        "product_brand",
    )


def flatten_event(events: DataFrame) -> DataFrame:
    """Nested events as the 15-column row."""
    return events.select(
        "order.order_id",
        "order.timestamp",
        "order.total_amount",
        "order.quantity",
        "order.shipping_cost",
        "order.tax_amount",
        "customer.customer_id",
        "customer.state",
        "customer.segment",
        "product.product_id",
        F.col("product.name").alias("product_name"),
        "product.category",
        "payment.payment_method",
        F.col("payment.status").alias("payment_status"),
        "payment.processing_time",
    )


def orders_with_payments(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    payments: DataFrame,
    order_key: str = "order_id",
    heads: DataFrame | None = None,
) -> DataFrame:
    """The 15-column row from the normalised tables.

    `order_key` is the order's column that payments name as their `order_id`. Orders may come
    in two frames: `heads` then has, once for each `order_key`, what several orders share, the
    customer and the time, and `orders` the rest. Customers and payments are joined to these
    fewer rows, before the orders, of which only those paid are shuffled to their product.
    """
    paid = payments.select(
        F.col("order_id").alias("paid_order"),
        "payment_method",
        F.col("status").alias("payment_status"),
        "processing_time",
    )
    has_paid = F.col(order_key) == F.col("paid_order")
    if heads is None:
        # Payments first: orders that lie by their key already are not shuffled for them.
        rows = join_customers(orders.join(paid, has_paid), customers)
    else:
        rows = orders.join(join_customers(heads, customers).join(paid, has_paid), order_key)
    return join_products(rows, products).select(
        "order_id",
        "timestamp",
        "total_amount",
        "quantity",
        "shipping_cost",
        "tax_amount",
        "customer_id",
        F.col("customer_state").alias("state"),
        F.col("customer_segment").alias("segment"),
        "product_id",
        "product_name",
        F.col("product_category").alias("category"),
        "payment_method",
        "payment_status",
        "processing_time",
    )


def join_coverage(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Orders loaded, joined and lost, in one pass over the orders.

    Only keys are looked up, each once however often a dimension repeats it, so an order
    stays one row and is shuffled only where a dimension is too large to broadcast.
    """
    known_customer = customers.select("customer_id").distinct().withColumn("has_customer", F.lit(True))
    known_product = products.select("product_id").distinct().withColumn("has_product", F.lit(True))
    looked_up = (
        orders.select("customer_id", "product_id")
        .join(known_customer, "customer_id", "left")
        .join(known_product, "product_id", "left")
    )
    no_customer = F.col("has_customer").isNull()
    no_product = F.col("has_product").isNull()
    return looked_up.agg(
        F.count(F.lit(1)).alias("loaded_orders"),
        F.count_if(~no_customer & ~no_product).alias("joined_orders"),
        F.count_if(no_customer).alias("without_customer"),
        F.count_if(no_product).alias("without_product"),
    )
