"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits; for each non-zero vector v there is a
mask of the positions whose vector has an odd product with v. Up to `radius` vectors never
span the whole space, so some v is orthogonal to all the positions in which two fingerprints
differ: under that mask they are equal. All pairs within the radius so meet in some of the
2 ** (radius + 1) - 1 tables, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from orderlens.llm.common import documents, join_hot, prepare, saved, with_id

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
# Fingerprints of a bucket that are compared with each other at once; a larger bucket is cut
# by further bits first, and what is still larger is compared block by block.
BUCKET = 2048
_SLICE = 65_536


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The majority of each bit over the XXH64 of all shingles; zero without words."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        whole, digest = memoryview(line), xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())),
            np.uint64,
            len(starts),
        )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(schema.field(0).type), pa.array(marks.view(np.int64))],
                schema=schema,
            )

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark): the 64 bits as a signed long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    texts = documents(docs, id_col, text_col)
    schema = with_id(texts, StructField("mark", LongType()))
    return texts.mapInArrow(_fingerprints(words, to_arrow_schema(schema)), schema)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks under one of which any two fingerprints within the radius are equal."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(marks: np.ndarray, radius: int) -> np.ndarray:
    """Rows (mark, smaller mark) that join the bucket's components, each a star or a chain of stars."""
    n = len(marks)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits = marks.view(np.uint64)
    for a in range(0, n, BUCKET):
        for b in range(a, n, BUCKET):
            near = np.bitwise_count(bits[a : a + BUCKET, None] ^ bits[None, b : b + BUCKET]) <= radius
            for i, row in enumerate(near):
                # The first row's links already join what lies in the same component.
                hits = np.flatnonzero(row[i + 1 :]) + i + 1 if a == b else np.flatnonzero(row)
                if len(hits):
                    mine = root(a + i)
                    for other in np.unique(parent[hits + b]):
                        theirs = root(int(other))
                        if theirs != mine:
                            low, high = min(mine, theirs), max(mine, theirs)
                            parent[high] = low
                            mine = low
    roots = np.array([root(i) for i in range(n)])
    moved = np.flatnonzero(roots != np.arange(n))
    return np.stack([marks[moved], marks[roots[moved]]], axis=1)


def _bucket_links(radius: int, key_columns: int):
    """Links within each bucket, from rows that come sorted by bucket."""

    def links(frame: pd.DataFrame) -> np.ndarray:
        keys = frame.iloc[:, :key_columns].to_numpy()
        marks = np.ascontiguousarray(frame["mark"].to_numpy())
        change = np.any(keys[1:] != keys[:-1], axis=1)
        starts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys)]))
        sizes = np.diff(starts)
        found = []
        two = starts[:-1][sizes == 2]
        a, b = marks[two], marks[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        found.append(np.stack([np.maximum(a, b)[near], np.minimum(a, b)[near]], axis=1))
        for i in np.flatnonzero(sizes > 2):
            found.append(_stars(np.sort(marks[starts[i] : starts[i + 1]]), radius))
        return np.concatenate(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            # All but the last bucket are whole.
            keys = frame.iloc[:, :key_columns].to_numpy()
            same = np.all(keys == keys[-1], axis=1)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield pd.DataFrame(links(pd.concat([*held, frame.iloc[:cut]])), columns=["child", "parent"])
                held = []
            elif held and not (held[0].iloc[0, :key_columns].to_numpy() == keys[0]).all():
                yield pd.DataFrame(links(pd.concat(held)), columns=["child", "parent"])
                held = []
            held.append(frame.iloc[cut:])
        if held:
            yield pd.DataFrame(links(pd.concat(held)), columns=["child", "parent"])

    return run


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(child, parent), parent < child: links that join exactly what the radius joins.

    `marks` has distinct fingerprints. A bucket's links are given as stars over its
    components, never as all of its pairs. Buckets over BUCKET fingerprints are first dealt
    anew: what differs there are bits outside of the mask, and of radius + 1 parts of those
    one must be equal, so a pair within the radius meets again under that part's bits.
    """
    masks = covering_masks(radius)
    width = -(-BITS // 2 // (radius + 1))
    # For each mask, further masks: the bits outside of it in radius + 1 parts.
    parts = []
    for mask in masks:
        outside = [i for i in range(BITS) if not mask >> i & 1]
        step = max(width, -(-len(outside) // (radius + 1)))
        parts.append([sum(1 << i for i in outside[j : j + step]) for j in range(0, len(outside), step)])
    tables = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = saved(
        marks.select(F.posexplode(tables).alias("table", "mask"), "mark").select(
            "table", F.col("mark").bitwiseAND(F.col("mask")).alias("key"), "mark"
        ),
        "tables",
    )
    sizes = saved(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    met = keyed.join(sizes, ["table", "key"])
    small = met.filter(F.col("n") <= BUCKET).drop("n")
    extra = F.array(*[F.array(*[F.lit(_signed(p)) for p in part]) for part in parts])
    large = (
        met.filter(F.col("n") > BUCKET)
        .select("table", "key", F.posexplode(extra[F.col("table")]).alias("part", "bits"), "mark")
        .select("table", "key", "part", F.col("mark").bitwiseAND(F.col("bits")).alias("rest"), "mark")
    )
    near = small.repartition("table", "key").sortWithinPartitions("table", "key")
    cut = large.repartition("table", "key", "part", "rest").sortWithinPartitions("table", "key", "part", "rest")
    kind = "child long, parent long"
    return (
        near.mapInPandas(_bucket_links(radius, 2), kind)
        .unionByName(cut.mapInPandas(_bucket_links(radius, 4), kind))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that an edge (child, parent), parent < child, names.

    Each round hangs every child to its smallest parent and its other parents to that one,
    until each child has one parent; then parents are replaced by their parents until all
    are roots. Rounds are written to the shared folder.
    """
    edges = saved(edges.select("child", "parent").distinct(), "edges")
    while True:
        least = edges.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("n"))
        least = saved(least, "least")
        if least.filter("n > 1").isEmpty():
            break
        others = (
            edges.join(least.filter("n > 1"), "child")
            .filter("parent > least")
            .select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        )
        edges = saved(
            least.select("child", F.col("least").alias("parent")).unionByName(others).distinct(), "edges"
        )
    tree = least.select(F.col("child").alias("node"), F.col("least").alias("root"))
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = saved(
            tree.join(up, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "tree",
        )
        tree = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            break
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, mark (its fingerprint), component_id, component_size.

    Documents are linked if their fingerprints differ in at most `radius` bits; component_id
    is the smallest doc_id that links reach, null ids last. Null and empty texts have the
    fingerprint zero and are linked like any other; repeated rows come out each. An empty
    table gives no rows.
    """
    rows = saved(fingerprints(docs, words, id_col, text_col), "marks")
    distinct = saved(
        rows.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct"
    )
    joined = saved(components(links(distinct.select("mark"), radius)), "components")
    rooted = distinct.join(joined.withColumnRenamed("node", "mark"), "mark", "left").withColumn(
        "root", F.coalesce("root", "mark")
    )
    rooted = saved(rooted, "rooted")
    best = saved(
        rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")),
        "best",
    )
    placed = saved(
        join_hot(rooted.select("mark", "n", "root"), best, "root", "component_size", "inner").select(
            "mark", "n", "component_id", "component_size"
        ),
        "placed",
    )
    return join_hot(rows, placed, "mark", "n", "inner").select(
        "doc_id", "mark", "component_id", "component_size"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those of a component other than its smallest doc_id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.filter(F.col("component_size") > 1).filter(
        F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))
    )
    gone = saved(gone.select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
