"""Exact duplicates: a two-pass Bloom filter finds hashes that may repeat, only those shuffle.

Pass one marks, for every row, two positions of a bit table, and keeps the positions that
were marked twice. A repeated hash has all of its positions marked twice; few others have.
Pass two tests each row against those: rows that cannot repeat pass straight through, the
rest are grouped by their whole SHA-256, so the filter decides only what is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import SPACE, documents, free_name, join_hot, prepare, saved

# Bits for each row, and the most bits of a filter (128 MB). Beyond 64 million rows the table
# gets denser: more rows than needed are shuffled then, the result stays the same.
BITS_PER_ROW = 16
MOST_BITS = 1 << 30
# Bits that one group of the build holds.
SLICE_BITS = 1 << 20
# Hashes that a task gathers before it sends their positions.
GATHERED = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def bit_count(rows: int) -> int:
    wanted = max(rows * BITS_PER_ROW, SLICE_BITS)
    return min(1 << (wanted - 1).bit_length(), MOST_BITS)


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions for each 64-bit hash; `bits` is a power of two."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(30)) & mask


def _marks(bits: int):
    def emit(hashes: np.ndarray) -> pa.RecordBatch:
        marked, times = np.unique(np.concatenate(positions(hashes, bits)), return_counts=True)
        part = (marked // np.uint64(SLICE_BITS)).astype(np.int64)
        offset = (marked % np.uint64(SLICE_BITS)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        rows = {"slice": [], "once": [], "twice": []}
        for a, b in zip(edges[:-1], edges[1:]):
            rows["slice"].append(int(part[a]))
            rows["once"].append(offset[a:b].tobytes())
            rows["twice"].append(offset[a:b][times[a:b] > 1].tobytes())
        return pa.RecordBatch.from_pydict(
            rows,
            schema=pa.schema([("slice", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= GATHERED:
                yield emit(np.concatenate(held))
                held, n = [], 0
        if n:
            yield emit(np.concatenate(held))

    return run


def _twice(group: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: the bits that two tasks, or one task twice, have marked."""
    once = np.zeros(SLICE_BITS, bool)
    twice = np.zeros(SLICE_BITS, bool)
    for seen, again in zip(group["once"], group["twice"]):
        at = np.frombuffer(seen, np.uint32)
        twice[at[once[at]]] = True
        once[at] = True
        twice[np.frombuffer(again, np.uint32)] = True
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "bits": [np.packbits(twice).tobytes()]})


def may_repeat(hashes: DataFrame):
    """A function of a hash column: false only where the hash occurs once in `hashes`."""
    spark = hashes.sparkSession
    bits = bit_count(hashes.count())
    marks = hashes.mapInArrow(_marks(bits), "slice long, once binary, twice binary")
    table = np.zeros(bits // 8, np.uint8)
    step = SLICE_BITS // 8
    for row in marks.groupBy("slice").applyInPandas(_twice, "slice long, bits binary").toLocalIterator():
        table[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        bitmap, found = shared.value, None
        for at in positions(column.to_numpy().view(np.uint64), bits):
            hit = (bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
            found = hit if found is None else found & hit
        return pd.Series(found.astype(bool))

    return test


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space became one blank; null is
    empty, so null and empty texts are one group. The row with the smallest id stays, null
    ids last; of rows that share that id too, one stays. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    texts = documents(docs, id_col, text_col)
    rows = saved(
        texts.select("doc_id", digest(F.col("text")).alias("text_sha256"))
        .withColumn("hash", F.xxhash64("text_sha256"))
        .withColumn("row", F.monotonically_increasing_id()),
        "hashed",
    )
    test = may_repeat(rows.select("hash"))
    straight = rows.filter(~test("hash"))
    suspects = rows.filter(test("hash"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    groups = saved(
        suspects.groupBy("text_sha256")
        .agg(first.alias("first"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(
            "text_sha256",
            "group_size",
            F.col("first.doc_id").alias("keep_id"),
            F.col("first.row").alias("keep_row"),
        ),
        "repeated",
    )
    alone = F.col("group_size").isNull()
    met = join_hot(suspects, groups, "text_sha256", "group_size").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
    return straight.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    ).unionByName(met)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all of their columns; the rule is that of exact_duplicates.

    Rows that cannot repeat are not shuffled. Of the others each task keeps one row for each
    text before the shuffle, so a large group of copies is a few rows there.
    """
    prepare(docs.sparkSession)
    sha, number = free_name(docs, "sha"), free_name(docs, "hash")
    marked = docs.withColumn(sha, digest(F.col(f"`{text_col}`"))).withColumn(number, F.xxhash64(f"`{sha}`"))
    test = may_repeat(saved(marked.select(F.col(number).alias("hash")), "hashes"))
    straight = marked.filter(~test(number)).select(docs.columns)
    key = F.col(f"`{id_col}`")
    order = F.struct(key.isNull(), key, F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stays = marked.filter(test(number)).groupBy(sha).agg(F.min_by(whole, order).alias("whole"))
    return straight.unionByName(stays.select("whole.*"))
