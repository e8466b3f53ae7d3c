"""Published result sets: written by a refresh, read by name.

    <root>/<name>/data/<version>       rows of one version
    <root>/<name>/_current/<version>   marker: readers take the greatest

A version is written whole before its marker is set, so a reader never sees half a result,
and a failed refresh leaves the earlier version in force.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.sources import files

KEPT_VERSIONS = 5


def publish(
    spark: SparkSession,
    root: str,
    name: str,
    result: DataFrame,
    version: int | None = None,
    keep: int = KEPT_VERSIONS,
) -> None:
    """Replace the result set `name`. Publishing one version twice is one publication."""
    version = time.time_ns() if version is None else version
    mark = f"{version:020d}"
    result.write.mode("overwrite").parquet(f"{root}/{name}/data/{mark}")
    files.set_marker(spark, f"{root}/{name}/_current", mark)
    marks = files.names(spark, f"{root}/{name}/_current")
    for old in [m for m in marks if not m.startswith(".")][:-keep]:
        files.drop(spark, f"{root}/{name}/_current/{old}")
        files.drop(spark, f"{root}/{name}/data/{old}")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The version in force, or none."""
    mark = files.top_marker(spark, f"{root}/{name}/_current")
    return None if mark is None else spark.read.parquet(f"{root}/{name}/data/{mark}")


def published_or_compute(
    spark: SparkSession, root: str, name: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """The published result, else a computed one; `from_cache` says which."""
    published = read_published(spark, root, name)
    found = published is not None
    return (published if found else compute()).withColumn("from_cache", F.lit(found))


def published_names(spark: SparkSession, root: str) -> list[str]:
    """The names of the result sets that have a version in force."""
    folders = files.names(spark, root)
    return [n for n in folders if files.top_marker(spark, f"{root}/{n}/_current") is not None]


def published_count(spark: SparkSession, root: str) -> DataFrame:
    count = len(published_names(spark, root))
    return spark.range(1).select(F.lit(count).cast("long").alias("result_sets"))
