"""Hot and cold tier: archive old orders, register them, keep the rest.

The order of steps makes a failure harmless: write the archive, compare the rows it holds with
those that went into it, record it in the manifest and the catalog, and only then take its
orders out of the hot tier. Until that last step readers see the hot tier as it was, and a
rerun with the same archive id replaces what an earlier attempt left.

Orders of the hot tier lie by day: the scan for old ones lists no day after the cut-off, and
taking them out drops whole days and writes no more than the one day that the cut-off is in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from orderlens import schemas
from orderlens.functions.sizes import MIB, document_bytes, megabytes
from orderlens.functions.times import AsOf, minutes_before, moment
from orderlens.operators.health import ARCHIVE_AT_MB, archive_gate
from orderlens.sources.store import BATCH, DAY, HotStore, utc_day

# Fixed value: how long orders stay in the hot tier once it is full.
RETENTION_MINUTES = 5
ARCHIVES = "archives"
METADATA = "metadata"
MANIFEST_TABLE = "archive_manifest"


def cutoff_before(as_of: AsOf = None, minutes: float = RETENTION_MINUTES) -> Column:
    """The time before which orders are old."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    return minutes_before(now, minutes)


def _bound(orders: DataFrame, cutoff: AsOf | Column) -> Column:
    if isinstance(cutoff, Column):
        return cutoff.cast(orders.schema["timestamp"].dataType)
    return moment(orders, "timestamp", cutoff)


def candidates(orders: DataFrame, cutoff: AsOf | Column) -> DataFrame:
    """Orders before the cut-off. The bound is a literal, so the scan skips what is newer.

    Of orders that lie by day, later days are not listed.
    """
    bound = _bound(orders, cutoff)
    if DAY in orders.columns:
        orders = orders.where(F.col(DAY) <= utc_day(bound))
    return orders.where(F.col("timestamp") < bound)


def remainder(orders: DataFrame, cutoff: AsOf | Column) -> DataFrame:
    """The complement: newer orders, and those without a time.

    Both conditions reach the scan, so keeping a few minutes out of a large tier reads only
    the row groups in which they lie.
    """
    return orders.where((F.col("timestamp") >= _bound(orders, cutoff)) | F.col("timestamp").isNull())


def archives_path(cold: str) -> str:
    return f"{cold}/{ARCHIVES}"


def archive_path(cold: str, archive_id: str) -> str:
    return f"{archives_path(cold)}/archive_id={archive_id}"


def archive_id_at(time: Column) -> Column:
    """The id of an archive that is made at this time."""
    return F.concat(F.lit("archive_"), F.unix_seconds(time.cast("timestamp")).cast("string"))


def new_archive_id(spark: SparkSession) -> str:
    return spark.range(1).select(archive_id_at(F.current_timestamp()).alias("id")).first()["id"]


def write_archive(rows: DataFrame, cold: str, archive_id: str) -> DataFrame:
    """Write one archive, replacing an earlier one of this id, and read it back.

    Other archives are not touched. Scan tasks become files: Spark packs small input files
    into tasks of one split size, so archives do not inherit the micro-batches' small files.
    """
    path = archives_path(cold)
    (
        rows.withColumn("archive_id", F.lit(archive_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("archive_id")
        .parquet(path)
    )
    return read_archives(rows.sparkSession, cold, rows.schema).where(
        F.col("archive_id") == archive_id
    )


def read_archives(
    spark: SparkSession, cold: str, schema: T.StructType | None = None
) -> DataFrame:
    """All archives, with `archive_id` as the partition column."""
    reader = spark.read
    if schema is not None:
        kept = [f for f in schema.fields if f.name != "archive_id"]
        reader = reader.schema(T.StructType([*kept, T.StructField("archive_id", T.StringType())]))
    return reader.parquet(archives_path(cold))


def manifest_row(
    archive: DataFrame,
    archive_id: str,
    location: str,
    cutoff: AsOf | Column,
    size_before_mb: float,
    as_of: AsOf = None,
    source: str = "hot_store",
    database: str = "orders",
    collection: str = "orders",
) -> DataFrame:
    """One row on an archive, its count taken from the archive itself."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    bound = cutoff if isinstance(cutoff, Column) else F.lit(str(cutoff))
    counted = archive.agg(F.count(F.lit(1)).alias("record_count"))
    return counted.select(
        now.alias("archive_timestamp"),
        F.lit(source).alias("source"),
        F.lit(database).alias("database"),
        F.lit(collection).alias("collection"),
        bound.cast("timestamp").alias("threshold_date"),
        "record_count",
        F.lit(location).alias("storage_location"),
        F.lit(float(size_before_mb)).alias("size_before_mb"),
        F.lit("parquet").alias("format"),
        F.current_timestamp().alias("created_at"),
        F.lit(archive_id).alias("archive_id"),
    )


def create_catalog(spark: SparkSession, cold: str, database: str, use: bool = False) -> None:
    """The catalog database and its manifest table, where absent."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{cold}/catalog'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.MANIFEST.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.{MANIFEST_TABLE} ({columns})"
        f" USING PARQUET PARTITIONED BY (archive_id) LOCATION '{cold}/manifest'"
    )
    if use:
        spark.catalog.setCurrentDatabase(database)


def record_archive(row: DataFrame, cold: str, database: str, archive_id: str) -> None:
    """Put the manifest row into the catalog's table and beside the archive as JSON.

    The table is partitioned by archive id and the row replaces its partition, so recording
    an archive twice leaves one row.
    """
    columns = ", ".join(f"`{name}`" for name in schemas.MANIFEST.names if name != "archive_id")
    row.sparkSession.sql(
        f"INSERT OVERWRITE {database}.{MANIFEST_TABLE} PARTITION (archive_id = '{archive_id}')"
        f" SELECT {columns} FROM {{row}}",
        row=row,
    )
    row.write.mode("overwrite").json(f"{cold}/{METADATA}/{archive_id}")


def register_archive(
    spark: SparkSession, cold: str, database: str, archive_id: str, schema: T.StructType
) -> str:
    """A table over one archive, with the schema that was written."""
    name = f"{database}.archived_orders_{archive_id}"
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "archive_id"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns})"
        f" USING PARQUET LOCATION '{archive_path(cold, archive_id)}'"
    )
    spark.catalog.refreshTable(name)
    return name


def manifest(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.{MANIFEST_TABLE}")


def archive_count(spark: SparkSession, database: str) -> DataFrame:
    return manifest(spark, database).agg(F.count(F.lit(1)).alias("total_archives"))


def archive_report(
    spark: SparkSession, archived: int, remaining: int, bytes_before: int, bytes_after: int
) -> DataFrame:
    """Archived and remaining orders, and the hot tier's size before and after."""
    before, after = (megabytes(F.lit(n)) for n in (bytes_before, bytes_after))
    return spark.range(1).select(
        F.lit(archived).cast("long").alias("archived_orders"),
        F.lit(remaining).cast("long").alias("remaining_orders"),
        before.alias("size_before_mb"),
        after.alias("size_after_mb"),
        (before - after).alias("saved_mb"),
    )


def archive_old_orders(
    store: HotStore,
    cold: str,
    cutoff: AsOf | Column,
    database: str = "order_archive",
    archive_id: str | None = None,
    threshold_mb: float = ARCHIVE_AT_MB,
) -> DataFrame | None:
    """One archive run: gate, write, verify, record, take the archived orders out.

    Returns the report, or none where the tier is below the threshold or nothing is old.
    A run that is repeated after it has finished finds nothing old and changes nothing; one
    that finds more is refused, as replacing a finished archive would lose its orders.

    The tier has one writer at a time: a run goes between two batches, as the stream's
    `after_batch`, or while no stream writes. The sizes it reports are noted by the writes.
    An archive id names tables: letters, digits and underscores.
    """
    spark = store.spark
    archive_id = archive_id or new_archive_id(spark)
    if not re.fullmatch(r"[A-Za-z0-9_]+", archive_id):
        raise ValueError(f"archive id {archive_id!r}: only letters, digits and underscores")
    if isinstance(cutoff, Column) or cutoff is None:
        cutoff = _fixed(spark, cutoff if cutoff is not None else cutoff_before())
    store.finish_removal()
    gate = archive_gate(store.size(), threshold_mb).first()
    if not gate["needs_archiving"]:
        return None
    going = candidates(store.dated_orders(), cutoff).drop(DAY, BATCH)
    if going.isEmpty():
        return None
    if store.has_removal(archive_id):
        # Its orders are in the archive alone: writing it anew would lose them.
        raise ValueError(f"archive {archive_id} is complete, newer orders need another id")
    noted = Observation("archived")
    size = F.sum(document_bytes(going)).cast("long").alias("bytes")
    archive = write_archive(going.observe(noted, F.count(F.lit(1)).alias("rows"), size), cold, archive_id)
    written = archive.count()
    if written != noted.get["rows"]:
        raise RuntimeError(f"archive {archive_id} holds {written} of {noted.get['rows']} orders")

    location = archive_path(cold, archive_id)
    create_catalog(spark, cold, database)
    row = manifest_row(archive, archive_id, location, cutoff, gate["bytes"] / MIB)
    record_archive(row, cold, database, archive_id)
    register_archive(spark, cold, database, archive_id, archive.schema)

    store.remove_orders(cutoff, archive_id, written, noted.get["bytes"])
    remaining, _ = store.order_size()
    after = store.size().first()
    return archive_report(spark, written, remaining, gate["bytes"], after["bytes"])


def _fixed(spark: SparkSession, point: Column) -> str:
    """A moving cut-off as text, so that every step of a run uses the same one."""
    text = F.date_format(point, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return spark.range(1).select(text.alias("t")).first()["t"]

