"""Spark results against DuckDB over the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain_rows, key=repr)


def difference(df, connection, sql) -> str | None:
    """The first difference, or none."""
    names, got = canonical(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    wanted_names, wanted = canonical([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} / {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows / {len(wanted)}"
    for left, right in zip(got, wanted):
        if left != right:
            return f"{left} / {right}"
    return None
