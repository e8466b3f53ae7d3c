"""What several operators share: saved tables, bounded Arrow batches, joins with hot keys."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from orderlens.session import work_dir

# White space as the contracts have it: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

# Rows in an Arrow batch. Texts can be long, so a batch of Spark's 10,000 rows is not bounded
# enough for a Python worker.
BATCH_ROWS = 256

# Groups that may be broadcast. Each group outside of the 1000 largest has fewer than a
# thousandth of all rows, however skewed they are.
HOT_GROUPS = 1000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches; lets Python workers import this package from where it lies.

    On a cluster the package goes with the job (`--py-files`); the path only matters where
    the workers see the same disk.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives executors."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, under these names, null text as empty: other columns cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def with_id(docs: DataFrame, *fields: StructField, name: str = "doc_id") -> StructType:
    """A schema that starts with the id as the input has it."""
    return StructType([StructField(name, docs.schema[name].dataType), *fields])


def join_hot(
    rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left", by: str = "merge"
) -> DataFrame:
    """`rows` with the columns of their group; `groups` has one row per key and is saved.

    The largest groups, a bounded number, come by broadcast, so their rows stay where they
    are; the rows of all others meet in a shuffle, where no key has a thousandth of them.
    Wide rows are better joined `by` "shuffle_hash", which does not sort them.
    """
    hot = saved(groups.orderBy(F.col(size).desc(), key).limit(HOT_GROUPS), "hot")
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return near.unionByName(far.join(groups.hint(by), key, how))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
