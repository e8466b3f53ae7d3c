"""Repeated passages across documents, by content-defined chunking.

A gear rolling hash runs over the bytes; a chunk ends where the hash is the largest within
REACH bytes to both sides. Where a chunk ends depends on the bytes around alone, so a passage
is cut the same wherever it stands, and an insertion moves the chunks beside it only. Chunks
are counted by digest; runs of chunks that several documents have are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from orderlens.llm.common import documents, join_hot, prepare, saved, with_id

# Bytes to both sides in which a boundary's hash is the largest: chunks are twice that on average.
REACH = 24
# Words of a run of repeated chunks from which on it is reported. A run leaves out what a
# passage's first and last chunk share with their surroundings, so it is shorter than the
# passage: this catches passages of some 50 words.
LEAST_WORDS = 16
GEAR_BITS = 32


def gear(seed: int = 17) -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << GEAR_BITS, 256, np.uint32)


_GEAR = gear()
_SLICE = 1 << 22


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hashes: each the sum of the last 32 bytes' numbers, shifted left by their age."""
    hashes = _GEAR[data]
    step = 1
    while step < GEAR_BITS:
        older = hashes[:-step] << np.uint32(step)
        hashes[step:] += older
        step *= 2
    return hashes


def _largest_near(hashes: np.ndarray) -> np.ndarray:
    """Where a hash exceeds all REACH before it and none of REACH after exceeds it."""
    n = len(hashes)
    padded = np.concatenate([np.zeros(REACH, np.uint32), hashes, np.zeros(REACH, np.uint32)])
    widest, width = padded, 1
    while width * 2 <= REACH:
        widest = np.maximum(widest[:-width], widest[width:])
        width *= 2
    window = np.maximum(widest[: len(padded) - REACH + 1], widest[REACH - width : REACH - width + len(padded) - REACH + 1])
    return (hashes > window[:n]) & (hashes >= window[REACH + 1 : REACH + 1 + n])


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of chunks in bytes, the text's own last. No character is cut."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(_largest_near(rolling(data))) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return np.append(ends, len(data))


def _chunks(schema: pa.Schema):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = boundaries(data)
                if not len(ends):
                    continue
                starts = np.concatenate(([0], ends[:-1]))
                whole, digest = memoryview(raw), xxhash.xxh64_intdigest
                marks = np.fromiter(
                    (digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends)
                )
                characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~blank
                begins[1:] &= blank[:-1]
                words = np.concatenate(([0], np.cumsum(begins)))
                owner.append(np.full(len(ends), i))
                parts.append(
                    (np.arange(len(ends)), characters[starts], characters[ends], words[ends] - words[starts], marks.view(np.int64))
                )
            if not parts:
                continue
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(owner))).cast(schema.field(0).type),
                    batch.column(2).take(pa.array(np.concatenate(owner))),
                    *(pa.array(c.astype(np.int32)) for c in columns[:4]),
                    pa.array(columns[4]),
                ],
                schema=schema,
            )

    return run


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, number, start, end, words, digest) of every chunk, saved; from (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    schema = with_id(
        rows,
        StructField("row", LongType()),
        *[StructField(name, IntegerType()) for name in ("number", "start", "end", "words")],
        StructField("digest", LongType()),
    )
    return saved(rows.select("doc_id", "text", "row").mapInArrow(_chunks(to_arrow_schema(schema)), schema), "chunks")


def repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per repeated passage and place: doc_id, start, end, words, first_doc, occurrences, removed.

    A passage is a run of chunks each of which at least two documents have. `removed` is
    false where no earlier document (by doc_id) has it, so one copy stays; start and end are
    code points, end exclusive; `occurrences` are those of its rarest chunk. Documents without
    repeated passages have no row. Null and empty texts have no chunks; repeated rows of one
    doc_id count as one document, and a null id never does. An empty table gives no rows.
    """
    pieces = chunks(documents(docs, id_col, text_col))
    groups = saved(
        pieces.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter(F.col("first_doc") != F.col("last_doc"))
        .drop("last_doc"),
        "repeated",
    )
    met = join_hot(pieces, groups, "digest", "n", "inner").withColumn(
        "removed", F.coalesce(F.col("doc_id") != F.col("first_doc"), F.lit(True))
    )
    run = W.partitionBy("row", "removed").orderBy("number")
    return (
        met.withColumn("run", F.col("number") - F.row_number().over(run))
        .groupBy("doc_id", "row", "removed", "run")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            F.sum("words").alias("words"),
            F.min("first_doc").alias("first_doc"),
            F.min("n").alias("occurrences"),
        )
        .filter(F.col("words") >= least_words)
        .select("doc_id", "start", "end", "words", "first_doc", "occurrences", "removed")
    )
