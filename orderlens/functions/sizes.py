"""The size a row takes in a BSON document store, from the published BSON layout.

The size of the hot tier is what triggers archiving. It is a sum of constants and of text
lengths: no row is encoded, and of a stored table only text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MIB = 1024 * 1024

# Bytes of a BSON value, of the frame round a document and of its `_id`.
VALUE_BYTES = {
    T.BooleanType: 1,
    T.IntegerType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.DateType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}
DOCUMENT_BYTES = 5
ID_BYTES = 17
TEXT_FRAME_BYTES = 5


def _value_bytes(path: str, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return f"octet_length({path}) + {TEXT_FRAME_BYTES}"
    if isinstance(kind, T.StructType):
        return f"{_fields_bytes(kind, path + '.')} + {DOCUMENT_BYTES}"
    return str(VALUE_BYTES[type(kind)])


def _fields_bytes(schema: T.StructType, prefix: str = "") -> str:
    names = sum(len(field.name.encode()) + 2 for field in schema.fields)
    parts = [f"{names}L"]
    for field in schema.fields:
        path = f"{prefix}`{field.name}`"
        parts.append(f"if({path} IS NULL, 0, {_value_bytes(path, field.dataType)})")
    return " + ".join(parts)


def document_bytes(df: DataFrame) -> Column:
    """Bytes of one row of `df` as a document with an object id."""
    return F.expr(f"{_fields_bytes(df.schema)} + {DOCUMENT_BYTES + ID_BYTES}")


def megabytes(size: Column) -> Column:
    return size.cast("double") / F.lit(float(MIB))
