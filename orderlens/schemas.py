"""Column layouts of the event, the hot tables and the archive manifest."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from `name type, ..`; unlike Spark's own, usable before a session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# As they arrive: ISO times are text.
EVENT_ORDER = _struct(
    "order_id string, customer_id string, product_id string, timestamp string, quantity int,"
    " unit_price double, total_amount double, shipping_cost double, tax_amount double,"
    " order_status string"
)
EVENT_CUSTOMER = _struct(
    "customer_id string, name string, email string, city string, state string,"
    " country string, registration_date string, segment string"
)
EVENT_PRODUCT = _struct(
    "product_id string, name string, category string, subcategory string, brand string,"
    " cost_price double, list_price double"
)
EVENT_PAYMENT = _struct(
    "payment_id string, order_id string, payment_method string, status string,"
    " processing_time double, timestamp string"
)
EVENT = T.StructType(
    [
        T.StructField("order", EVENT_ORDER),
        T.StructField("customer", EVENT_CUSTOMER),
        T.StructField("product", EVENT_PRODUCT),
        T.StructField("payment", EVENT_PAYMENT),
    ]
)


def _stored(schema: T.StructType, **types: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, types.get(f.name, f.dataType)) for f in schema.fields]
    )


# As stored: parsed times.
ORDERS = _stored(EVENT_ORDER, timestamp=T.TimestampType())
CUSTOMERS = _stored(EVENT_CUSTOMER, registration_date=T.DateType())
PRODUCTS = EVENT_PRODUCT
PAYMENTS = _stored(EVENT_PAYMENT, timestamp=T.TimestampType())

UPSERT_KEYS = {"customers": "customer_id", "products": "product_id", "payments": "payment_id"}

# The names of the fields set by a change, kept beside it so that a field which was absent
# can be told from one that was null.
PRESENT = T.StructField("present", T.ArrayType(T.StringType()))

MINUTES = _struct("minute_start timestamp, revenue bigint, n_orders bigint")

DEAD_LETTERS = _struct("value string, reason string")

MANIFEST = _struct(
    "archive_timestamp timestamp, source string, database string, collection string,"
    " threshold_date timestamp, record_count bigint, storage_location string,"
    " size_before_mb double, format string, created_at timestamp, archive_id string"
)
