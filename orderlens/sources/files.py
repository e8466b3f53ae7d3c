"""Small file-system steps, through Hadoop so that they work on any shared store.

Only names are handled here. A marker is an empty file whose name is its content, so
setting one is a single atomic creation, and a reader takes the greatest name.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order, without hidden ones; none if the folder is not there."""
    fs, where = _path(spark, path)
    if not fs.exists(where):
        return []
    found = sorted(status.getPath().getName() for status in fs.listStatus(where))
    return [name for name in found if not name.startswith(".")]


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern."""
    fs, where = _path(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(where) or []]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not there: written beside, then renamed."""
    fs, where = _path(spark, path)
    _, beside = _path(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def make_dir(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.mkdirs(where)


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def set_marker(spark: SparkSession, folder: str, name: str) -> bool:
    """Create a marker; false if it was there already."""
    fs, where = _path(spark, f"{folder}/{name}")
    return fs.createNewFile(where)


def top_marker(spark: SparkSession, folder: str) -> str | None:
    found = names(spark, folder)
    return found[-1] if found else None
