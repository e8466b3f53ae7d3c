"""Ranked lexical search without an index: an automaton of all search terms reads the texts.

The terms of a block of items become one Aho-Corasick automaton, each between two separators,
so that only whole terms are found. It is broadcast and reads the documents twice: once to
count how many documents hold each term, and once to score. What leaves a task of the second
pass is each item's best documents of that task, never a term or a posting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from orderlens.llm.common import prepare, saved

# What separates terms: the characters below 128 that are neither digits nor letters.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{SEPARATORS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of the terms (repeats within an item folded) that one block of items may hold. What is
# broadcast and collected grows with a block, not with the items; each block reads the texts.
BLOCK_BYTES = 8 << 20
# Documents that a task scores before it cuts to the best again.
_CUT = 1 << 14
# Parts that a task's best are dealt to before the last comparison.
_DEALS = 64

# Separators become blanks and A-Z becomes a-z; bytes above 127 are parts of terms.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): the terms of each item, an item being one row."""
    rows = saved(
        items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).withColumn(
            "item", F.monotonically_increasing_id()
        ),
        "items",
    )
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    terms = rows.select("item", "item_id", F.explode(found).alias("term"))
    return saved(terms.groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "terms")


def block_count(terms: DataFrame, block_bytes: int) -> int:
    """Blocks to deal the items to by hash, so that none holds much more than the bytes.

    Doubled until the largest block fits or holds a single item.
    """
    sizes = saved(
        terms.groupBy("item").agg(F.sum(F.octet_length("term") + 16).alias("size")), "item_sizes"
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:
        largest = (
            sizes.groupBy(_block(blocks)).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.desc("size"))
        ).first()
        if largest is None or largest["size"] <= 2 * block_bytes or largest["n"] == 1:
            return blocks
        blocks *= 2


def _block(blocks: int):
    return F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")


@dataclass(frozen=True)
class Block:
    """Items and terms of a block, numbered; a term's items lie in [starts[t], starts[t + 1])."""

    words: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int


def _block_of(terms: DataFrame) -> tuple[Block, list[tuple]]:
    """The block, and (item number, id) of its items. The caller has bounded its size."""
    rows = terms.orderBy("term", "item").collect()
    ids = {row["item"]: row["item_id"] for row in rows}
    numbers = {item: i for i, item in enumerate(ids)}
    words = sorted({row["term"] for row in rows})
    places = {word: i for i, word in enumerate(words)}
    rows.sort(key=lambda row: places[row["term"]])
    term = np.array([places[row["term"]] for row in rows], np.int64)
    block = Block(
        [word.encode("utf-8", "surrogatepass") for word in words],
        np.searchsorted(term, np.arange(len(words) + 1)),
        np.array([numbers[row["item"]] for row in rows], np.int64),
        np.array([row["times"] for row in rows], np.int64),
        len(ids),
    )
    return block, [(numbers[item], held) for item, held in ids.items()]


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Finds each word between two blanks; bytes are taken as the characters of their number."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(words):
        machine.add_word(f" {word.decode('latin-1')} ", i)
    machine.make_automaton()
    return machine


def count_terms(machine: ahocorasick.Automaton, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has with repeats, and which of the automaton's it holds how often."""
    line = b" " + text.encode("utf-8", "surrogatepass").translate(_PLAIN) + b" "
    held = np.frombuffer(line, np.uint8) != 32
    n = int(np.count_nonzero(held[1:] > held[:-1]))
    found = np.fromiter((term for _, term in machine.iter(line.decode("latin-1"))), np.int64)
    terms, tf = np.unique(found, return_counts=True)
    return n, terms, tf.astype(np.int64)


def _counts(shared):
    """One row per term of a task: documents that hold it. Term -1: documents and terms of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        machine = automaton(block.words)
        df = np.zeros(len(block.words), np.int64)
        documents = occurrences = 0
        for batch in batches:
            for text in batch.column("text"):
                n, terms, _ = count_terms(machine, text.as_py())
                documents += n > 0
                occurrences += n
                df[terms] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict(
            {
                "term": np.concatenate(([-1], held)),
                "n": np.concatenate(([documents], df[held])),
                "occurrences": np.concatenate(([occurrences], np.zeros(len(held), np.int64))),
            }
        )

    return run


def weight(documents: int, holding: int) -> int:
    """A term's weight from the documents there are and those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def text_measure(n: int, documents: int, occurrences: int) -> int:
    """What a document's length divides by: 100 for a text of mean length."""
    return 100 - 75 + 75 * n * documents // occurrences


def _scores(block: Block, weights: np.ndarray, n: int, terms: np.ndarray, tf: np.ndarray, corpus: tuple[int, int]):
    """The score of each item of the block for one document."""
    out = np.zeros(block.n_items, np.int64)
    value = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * text_measure(n, *corpus)))
    first, sizes = block.starts[terms], block.starts[terms + 1] - block.starts[terms]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
    np.add.at(out, block.items[at], np.repeat(value, sizes) * block.times[at])
    return out


class _Best:
    """The best k documents of each item, equal scores by place in the order of ids."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.zeros(n_items, np.int64)  # scores below cannot enter any more
        self.items = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.ids: list = []
        self.fresh: list[tuple[np.ndarray, np.ndarray, object]] = []
        self.n_fresh = 0

    def add(self, scores: np.ndarray, doc_id) -> None:
        items = np.flatnonzero((scores > 0) & (scores >= self.least))
        if len(items):
            self.fresh.append((items, scores[items], doc_id))
            self.n_fresh += len(items)
            if self.n_fresh >= _CUT:
                self.cut()

    def cut(self) -> None:
        items = np.concatenate([self.items, *[f[0] for f in self.fresh]])
        scores = np.concatenate([self.scores, *[f[1] for f in self.fresh]])
        ids = self.ids + [f[2] for f in self.fresh for _ in range(len(f[0]))]
        places = {v: i for i, v in enumerate(sorted({i for i in ids if i is not None}))}
        place = np.array([places.get(i, len(places)) if i is not None else len(places) for i in ids], np.int64)
        order = np.lexsort((place, -scores, items))
        items, scores = items[order], scores[order]
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        stays = rank < self.k
        last = rank == self.k - 1
        self.least[items[last]] = scores[last]
        self.items, self.scores = items[stays], scores[stays]
        self.ids = [ids[i] for i in order[stays]]
        self.fresh, self.n_fresh = [], 0


def _ranks(shared, weights: np.ndarray, corpus: tuple[int, int], k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        machine = automaton(block.words)
        best = _Best(block.n_items, k)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, terms, tf = count_terms(machine, text.as_py())
                if len(terms):
                    best.add(_scores(block, weights, n, terms, tf, corpus), doc_id)
        best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.items), pa.array(best.ids, schema.field(1).type), pa.array(best.scores)], schema=schema
        )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 of each item.

    Scores are whole numbers. Equal scores go by ascending doc_id, null ids last; of repeated
    rows each has a rank of its own. A repeated item is searched once per row. Null and empty
    texts have no term: such documents count nowhere, such items find nothing, and an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.filter("text IS NOT NULL")
    kind = docs.schema[id_col].dataType
    terms = item_terms(items, item_id_col, item_text_col)
    blocks = block_count(terms, block_bytes)
    found = []
    for i in range(blocks):
        mine = terms.filter(_block(blocks) == i)
        block, ids = _block_of(mine)
        if block.words:
            found.append(_search_block(spark, texts, block, ids, items.schema[item_id_col].dataType, kind, k))
    if not found:
        result = StructType(
            [
                StructField("item_id", items.schema[item_id_col].dataType),
                StructField("rank", IntegerType()),
                StructField("doc_id", kind),
                StructField("score", LongType()),
            ]
        )
        return spark.createDataFrame([], result)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(spark: SparkSession, texts: DataFrame, block: Block, ids, item_kind, kind, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = spark.sparkContext.broadcast(block)
    counted = texts.mapInArrow(_counts(shared), "term long, n long, occurrences long")
    sums = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences"))
    df, corpus = np.zeros(len(block.words), np.int64), (0, 0)
    for row in sums.collect():  # one row per term of the block
        if row["term"] < 0:
            corpus = (row["n"], row["occurrences"])
        else:
            df[row["term"]] = row["n"]
    weights = np.array([weight(corpus[0], int(n)) for n in df], np.int64)

    schema = StructType(
        [StructField("item", LongType()), StructField("doc_id", kind), StructField("score", LongType())]
    )
    best = texts.mapInArrow(_ranks(shared, weights, corpus, k, to_arrow_schema(schema)), schema)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    dealt = best.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(_DEALS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order)))
    some = some.filter(F.col("rank") <= k).drop("rank", "deal")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    named = StructType([StructField("item", LongType()), StructField("item_id", item_kind)])
    numbers = spark.createDataFrame(ids, named)
    return (
        saved(ranked.filter(F.col("rank") <= k), "ranked")
        .join(F.broadcast(numbers), "item")  # the block's items, bounded with it
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
