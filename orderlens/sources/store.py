"""The hot tier: orders by day, and the tables that orders refer to by bucket of their key.

    <root>/orders/days=<k>/order_date=<d>/batch_id=<n>        orders of k days from d, of one batch
    <root>/<table>/buckets=<k>/bucket=<b>/batch_id=<n>        rows in force of a k-th of the keys
    <root>/dead_letters/batch_id=<n>                          events of one batch that are not whole
    <root>/notes/<n>.json                                     sizes after batch n: it is whole
    <root>/removals/<label>.json                              what an archive took out

A batch writes the days and buckets it touches, by dynamic partition overwrite, so a replay
replaces what the first attempt left. A bucket is read, merged with its changes and written
as a new version; readers take its last one and fold nothing. A batch is visible once its
note is written. Sizes are observed in the write itself and noted, so asking how large the
tier is reads no order.

There is one writer at a time: the stream, or between its batches an archive run. A reader
keeps the files that its plan has listed; a version is dropped two versions later.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from orderlens import schemas
from orderlens.functions.sizes import document_bytes
from orderlens.functions.times import AsOf, moment
from orderlens.operators.changes import PRESENT, fold_pairs
from orderlens.sources import files

BATCH = "batch_id"
BUCKET = "bucket"
PART = "part"
DAY = "order_date"

# Shares of a table's keys when it is first written. A batch reads and writes whole buckets.
BUCKETS = 64
# Rows of a bucket that one task merges: a larger bucket is dealt to several tasks by key.
TASK_ROWS = 500_000
# Days of a partition of the orders, when they are first written: more where days are small.
DAYS = 1
# Notes of batches that are kept, for the flow between them.
NOTES = 1000
# Batches of one day beyond which `compact` writes the day as one.
DAY_BATCHES = 100

SCHEMAS = {
    "orders": schemas.ORDERS,
    "customers": T.StructType([*schemas.CUSTOMERS.fields, schemas.PRESENT]),
    "products": T.StructType([*schemas.PRODUCTS.fields, schemas.PRESENT]),
    "payments": T.StructType([*schemas.PAYMENTS.fields, schemas.PRESENT]),
    "minutes": T.StructType([*schemas.MINUTES.fields, schemas.PRESENT]),
    "dead_letters": schemas.DEAD_LETTERS,
}
KEYS = {**schemas.UPSERT_KEYS, "minutes": "minute_start"}
SIZED = ("orders", *schemas.UPSERT_KEYS)
NOTE = "batch_id bigint, arrived bigint, rows map<string,bigint>, bytes map<string,bigint>"


def utc_day(time: Column, days: int = 1) -> Column:
    """The day of a time, or the first of its span of days, the same in every time zone."""
    number = F.floor(F.unix_seconds(time.cast("timestamp")) / (86_400 * days))
    return F.date_from_unix_date((number * days).cast("int"))


def _sizes(frame: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, Observation]:
    """The frame, and an observation of its rows and document bytes."""
    noted = Observation(name)
    size = F.coalesce(F.sum(document_bytes(frame.select(*columns))), F.lit(0)).cast("long")
    return frame.observe(noted, F.count(F.lit(1)).alias("rows"), size.alias("bytes")), noted


class HotStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, days: int = DAYS):
        """`buckets` and `days` count for tables that are not yet there; others keep theirs."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = {"buckets": buckets, "days": days}

    # -- writing ---------------------------------------------------------------------

    def write_batch(self, batch_id: int, frames: dict[str, DataFrame]) -> None:
        """All tables of one micro-batch, then the note that shows them.

        The last batch may come again, as Spark hands it in again after a failure, and then
        replaces its own rows. An earlier one cannot be a replay, so it is an error.
        """
        last = self.committed()
        if batch_id < last:
            raise ValueError(f"batch {batch_id} comes after batch {last} of {self.root}")
        self.finish_removal()
        before = self._note(batch_id - 1)
        rows, sizes, arrived = dict(before["rows"]), dict(before["bytes"]), 0
        for table, frame in frames.items():
            frame = frame.select(*SCHEMAS[table].names)
            if table in KEYS:
                change = self._upsert(table, frame, batch_id)
            else:
                change = self._append(table, frame, batch_id)
            if table in SIZED:
                rows[table] = rows.get(table, 0) + change[0]
                sizes[table] = sizes.get(table, 0) + change[1]
            if table == "orders":
                arrived = change[0]
        note = {BATCH: batch_id, "arrived": arrived, "rows": rows, "bytes": sizes}
        files.write_text(self.spark, f"{self.root}/notes/{batch_id:020d}.json", json.dumps(note))
        for table in frames:
            if table in KEYS:
                self._drop_versions(table, batch_id)
        for name in files.names(self.spark, f"{self.root}/notes")[:-NOTES]:
            files.drop(self.spark, f"{self.root}/notes/{name}")

    def _append(self, table: str, frame: DataFrame, batch_id: int) -> tuple[int, int]:
        columns = SCHEMAS[table].names
        dated, by = frame.withColumn(BATCH, F.lit(batch_id).cast("long")), [BATCH]
        if table == "orders":
            # Files by day, with a large day split and small ones merged at run time.
            day = utc_day(F.col("timestamp"), self._count("orders", "days"))
            dated, by = dated.withColumn(DAY, day).hint("rebalance", DAY), [DAY, BATCH]
        sized, noted = _sizes(dated, columns, "written")
        self._overwrite(sized, self._orders_folder() if table == "orders" else f"{self.root}/{table}", by)
        return noted.get["rows"], noted.get["bytes"]

    def _upsert(self, table: str, frame: DataFrame, batch_id: int) -> tuple[int, int]:
        """Merge changes, one row per key, into the buckets of their keys.

        What a task holds is bounded however large a bucket is: its keys are dealt to as many
        tasks as its rows ask for, and each writes a file of the bucket.
        """
        key, columns = KEYS[table], SCHEMAS[table].names
        n = self._count(table, "buckets")
        changes = frame.withColumn(BUCKET, _bucket_of(F.col(f"`{key}`"), n))
        new_rows = {r[BUCKET]: r["count"] for r in changes.groupBy(BUCKET).count().collect()}  # n at most
        touched = set(new_rows)
        in_bucket = max(new_rows.values(), default=0) + self._note(batch_id - 1)["rows"].get(table, 0) // n
        parts = -(-in_bucket // TASK_ROWS) or 1
        paths = self._versions(table, batch_id - 1)
        held = sorted(touched & paths.keys())
        part = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(parts))
        if held:
            old = self._read(table, [paths[b] for b in held])
            old, had = _sizes(old.withColumn(BUCKET, _bucket_of(F.col(f"`{key}`"), n)), columns[:-1], "had")
            every = F.array(*[F.lit(name) for name in columns[:-1]])
            both = old.withColumn(PRESENT, every).withColumn("_age", F.lit(0)).unionByName(
                changes.withColumn("_age", F.lit(1))
            )
            dealt = self._dealt(both.withColumn(PART, part), len(touched) * parts)
            merged = fold_pairs(dealt, key, "_age", within=(BUCKET, PART))
        else:
            # Nothing to merge with.
            merged = self._dealt(changes.withColumn(PART, part), len(touched) * parts)
        merged = merged.select(*columns, BUCKET).withColumn(BATCH, F.lit(batch_id).cast("long"))
        merged, has = _sizes(merged, columns[:-1], "has")
        self._overwrite(merged, self._folder(table, n), [BUCKET, BATCH])
        if not touched:
            return 0, 0
        return tuple(has.get[x] - (had.get[x] if held else 0) for x in ("rows", "bytes"))

    def _dealt(self, rows: DataFrame, tasks: int) -> DataFrame:
        """Rows by part of a bucket. Few parts are left to the session's number of tasks."""
        more = tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(*([tasks] if more else []), BUCKET, PART)

    @staticmethod
    def _overwrite(frame: DataFrame, path: str, by: list[str]) -> None:
        writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(path)

    def _folder(self, table: str, n: int) -> str:
        return f"{self.root}/{table}/buckets={n}"

    def _orders_folder(self) -> str:
        return f"{self.root}/orders/days={self._count('orders', 'days')}"

    def _count(self, table: str, what: str) -> int:
        """Buckets of a table, or days of the orders' partitions, as they lie."""
        held = [x for x in files.names(self.spark, f"{self.root}/{table}") if x.startswith(f"{what}=")]
        return int(held[0].split("=")[1]) if held else self.layout[what]

    def _versions(self, table: str, through: int) -> dict[int, str]:
        """Of each bucket, the path of its last version up to a batch."""
        last: dict[int, tuple[int, str]] = {}
        for bucket, batch, path in self._all_versions(table):
            if batch <= through:
                last[bucket] = max(last.get(bucket, (-1, "")), (batch, path))
        return {bucket: path for bucket, (_, path) in last.items()}

    def _all_versions(self, table: str) -> list[tuple[int, int, str]]:
        base = self._folder(table, self._count(table, "buckets"))
        found = []
        for path in files.glob(self.spark, f"{base}/{BUCKET}=*/{BATCH}=*"):
            bucket, batch = (int(part.split("=")[1]) for part in path.split("/")[-2:])
            found.append((bucket, batch, path))
        return found

    def _drop_versions(self, table: str, through: int) -> None:
        """All but the last two versions of each bucket: a replay starts from the one before."""
        held: dict[int, list[tuple[int, str]]] = {}
        for bucket, batch, path in self._all_versions(table):
            held.setdefault(bucket, []).append((batch, path))
        for versions in held.values():
            for batch, path in sorted(versions)[:-2]:
                files.drop(self.spark, path)

    # -- taking out ------------------------------------------------------------------

    def remove_orders(self, cutoff: AsOf, label: str, rows: int, size: int) -> None:
        """Take out the orders before the cut-off, `rows` of `size` bytes.

        Days (spans of days) before the cut-off's are dropped as they lie. Of its own day what
        stays is written beside, then the note that commits the removal, then the day is put
        back without the rest. `finish_removal` ends what a failure has cut short.
        """
        orders = self.dated_orders()
        bound = moment(orders, "timestamp", cutoff)
        day = self.spark.range(1).select(
            utc_day(bound, self._count("orders", "days")).cast("string").alias("day")
        ).first()["day"]
        days = [d for d in self._days() if d <= day]
        kept = orders.where(F.col(DAY) == F.lit(day).cast("date")).where(F.col("timestamp") >= bound)
        self._replace(label, days, kept, rows, size)

    def compact(self) -> list[str]:
        """Write days that came in many batches as one batch each; the days."""
        held: dict[str, list[str]] = {}
        for path in files.glob(self.spark, f"{self._orders_folder()}/{DAY}=*/{BATCH}=*"):
            day, batch = path.split("/")[-2:]
            held.setdefault(day.split("=")[1], []).append(batch.split("=")[1])
        last = self.committed()
        many = [
            day
            for day, batches in held.items()
            if len(batches) > DAY_BATCHES and _is_day(day) and str(last) not in batches
        ]
        for day in many:
            rows = self.dated_orders().where(F.col(DAY) == F.lit(day).cast("date"))
            batch = max(map(int, held[day]))
            self._replace(f"compact-{day}-{batch}", [day], rows.withColumn(BATCH, F.lit(batch).cast("long")), 0, 0)
        return many

    def _replace(self, label: str, days: list[str], kept: DataFrame, rows: int, size: int) -> None:
        kept.write.mode("overwrite").parquet(f"{self.root}/_moving/{label}")
        note = {"days": days, "rows": rows, "bytes": size}
        files.write_text(self.spark, f"{self.root}/removals/{label}.json", json.dumps(note))
        self.finish_removal()

    def finish_removal(self) -> None:
        """End a removal whose note is written; drop what was prepared for one that has none."""
        for label in files.names(self.spark, f"{self.root}/_moving"):
            moving = f"{self.root}/_moving/{label}"
            if self.has_removal(label):
                note = json.loads(files.read_text(self.spark, f"{self.root}/removals/{label}.json"))
                for day in note["days"]:
                    files.drop(self.spark, f"{self._orders_folder()}/{DAY}={day}")
                kept = self.spark.read.schema(self._dated_schema()).parquet(moving)
                self._overwrite(kept.hint("rebalance", DAY), self._orders_folder(), [DAY, BATCH])
            files.drop(self.spark, moving)

    def has_removal(self, label: str) -> bool:
        return files.exists(self.spark, f"{self.root}/removals/{label}.json")

    def _days(self) -> list[str]:
        held = files.names(self.spark, self._orders_folder())
        return [d for d in (x.removeprefix(f"{DAY}=") for x in held) if _is_day(d)]

    # -- reading ---------------------------------------------------------------------

    def committed(self) -> int:
        """The last whole batch, -1 if there is none."""
        held = files.names(self.spark, f"{self.root}/notes")
        return int(held[-1].split(".")[0]) if held else -1

    def dated_orders(self) -> DataFrame:
        """Orders with the columns they are partitioned by, `order_date` and `batch_id`."""
        rows = self._partitioned(self._orders_folder(), self._dated_schema())
        return rows.where(F.col(BATCH) <= self.committed())

    def orders(self) -> DataFrame:
        return self.dated_orders().drop(DAY, BATCH)

    def customers(self) -> DataFrame:
        return self._state("customers")

    def products(self) -> DataFrame:
        return self._state("products")

    def payments(self) -> DataFrame:
        return self._state("payments")

    def minutes(self) -> DataFrame:
        return self._state("minutes")

    def row(self, table: str, key: object) -> DataFrame:
        """The row of one key, from the one bucket it can be in."""
        n, name = self._count(table, "buckets"), KEYS[table]
        value = F.lit(key).cast(SCHEMAS[table][name].dataType)
        bucket = self.spark.range(1).select(_bucket_of(value, n).alias("b")).first()["b"]
        path = self._versions(table, self.committed()).get(bucket)
        return self._read(table, [path] if path else []).drop(PRESENT).where(F.col(name) == value)

    def dead_letters(self) -> DataFrame:
        schema = T.StructType([*schemas.DEAD_LETTERS.fields, T.StructField(BATCH, T.LongType())])
        rows = self._partitioned(f"{self.root}/dead_letters", schema)
        return rows.where(F.col(BATCH) <= self.committed()).drop(BATCH)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders(),
            "customers": self.customers(),
            "products": self.products(),
            "payments": self.payments(),
        }

    def progress(self) -> DataFrame:
        """Of each noted batch: batch_id, the orders that arrived, rows and bytes by table."""
        folder = f"{self.root}/notes"
        if not files.exists(self.spark, folder):
            return self.spark.createDataFrame([], NOTE)
        return self.spark.read.schema(NOTE).json(folder)

    def removed(self) -> tuple[int, int]:
        """Orders and bytes that have been taken out."""
        rows = size = 0
        for name in files.names(self.spark, f"{self.root}/removals"):
            note = json.loads(files.read_text(self.spark, f"{self.root}/removals/{name}"))
            rows, size = rows + note["rows"], size + note["bytes"]
        return rows, size

    def sizes(self) -> dict[str, tuple[int, int]]:
        """Rows and document bytes of each table, as noted when they were written."""
        note, gone = self._note(self.committed()), self.removed()
        held = {t: (note["rows"].get(t, 0), note["bytes"].get(t, 0)) for t in SIZED}
        held["orders"] = (held["orders"][0] - gone[0], held["orders"][1] - gone[1])
        return held

    def order_size(self) -> tuple[int, int]:
        return self.sizes()["orders"]

    def size(self) -> DataFrame:
        """Rows and bytes of the whole tier, in one row, from the notes."""
        rows, size = (sum(x) for x in zip(*self.sizes().values()))
        return self.spark.range(1).selectExpr(f"{rows}L AS rows", f"{size}L AS bytes")

    def _note(self, through: int) -> dict:
        held = files.names(self.spark, f"{self.root}/notes")
        held = [name for name in held if int(name.split(".")[0]) <= through]
        if not held:
            return {"rows": {}, "bytes": {}}
        return json.loads(files.read_text(self.spark, f"{self.root}/notes/{held[-1]}"))

    @staticmethod
    def _dated_schema() -> T.StructType:
        by = [T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.LongType())]
        return T.StructType([*schemas.ORDERS.fields, *by])

    def _partitioned(self, folder: str, schema: T.StructType) -> DataFrame:
        if not files.exists(self.spark, folder):
            return self._nothing(schema)
        return self.spark.read.schema(schema).parquet(folder)

    def _state(self, table: str) -> DataFrame:
        paths = self._versions(table, self.committed())
        return self._read(table, [paths[b] for b in sorted(paths)]).drop(PRESENT)

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self._nothing(SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def _nothing(self, schema: T.StructType) -> DataFrame:
        nulls = [f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
        return self.spark.range(0).selectExpr(*nulls)


def _bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _is_day(name: str) -> bool:
    return name[:1].isdigit() and len(name) == 10
