"""Prediction by partial matching over bytes, and a word-unigram base beside it.

A trie of byte contexts up to ORDER bytes holds how often each symbol followed; in a context
that is not the longest a symbol counts once for each longer context that led there. A symbol
that its context has not seen escapes to the next shorter one, where the symbols that the
longer one had are excluded. Escapes are estimated by method D: of twice a context's count
each of its different symbols gives one to the escape. A text's score is the sum of the
logarithms over the bytes of its words, single blanks between them, and its end.

The trie and the word counts grow with the corpus, so no task and no broadcast holds them.
Documents are put into blocks of bounded size; each block asks once for every different
context-with-symbol and word it has, in packed lists dealt out by hash; the trie's counts and
values are found by grouping and joins, and the answers go back to the block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, BinaryType, DoubleType, LongType, StructField, StructType

from orderlens.llm.common import documents, prepare, release, saved, with_id
from orderlens.llm.language import held_out

# Bytes of context. A context and its symbol are ORDER + 1 symbols of nine bits in a long.
ORDER = 5
WIDTH = 9
SYMBOLS = 257
END = 256
# Bytes of text in a block, and positions that are worked on at once.
BLOCK_BYTES = 16 << 20
_SLICE = 2 << 20
# The word that stands for the end of a text; real words are not empty.
END_WORD = b""
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers, texts = [], []
            for text in batch.column(1).to_pylist():
                data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
                if size and size + len(data) > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += len(data) + 1
                numbers.append(block)
                texts.append(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(schema.field(0).type),
                    batch.column(2),
                    pa.array(numbers, pa.int64()),
                    pa.array(texts, pa.binary()),
                ],
                schema=schema,
            )

    return run


def blocks(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """(doc_id, held_out, block, data): words in lower-case bytes; written, so blocks stay as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    schema = with_id(
        rows,
        StructField("held_out", BooleanType()),
        StructField("block", LongType()),
        StructField("data", BinaryType()),
    )
    return saved(rows.mapInArrow(_blocks(to_arrow_schema(schema)), schema), "blocks")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's contexts with symbol, end included, and where each text's begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER + 1)))
    symbols = np.full(starts[-1], END, np.uint64)
    for at, text in zip(starts, texts):
        symbols[at + ORDER : at + ORDER + len(text)] = np.frombuffer(text, np.uint8)
    keys = symbols.copy()
    for back in range(1, ORDER + 1):
        keys[back:] |= symbols[:-back] << np.uint64(WIDTH * back)
    inside = np.ones(len(symbols), bool)
    for pad in range(ORDER):
        inside[starts[:-1] + pad] = False
    return keys[inside].view(np.int64), np.concatenate(([0], np.cumsum(sizes + 1)))


class _Powers:
    """Powers of an odd number modulo 2 ** 64, of its inverse, and a random number per byte."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) | 1
        self.of_byte = rng.integers(0, 1 << 63, 256).astype(np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64)
                for x in (self.base, inverse)
            )


_POWERS = _Powers(11)
# Words of more bytes are hashed one by one.
_LONG_WORD = 64


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of words with single blanks between."""
    symbols = np.frombuffer(data, np.uint8)
    if not len(symbols):
        return np.zeros(0, np.int64)
    powers = _POWERS
    powers.reach(len(symbols))
    blanks = np.flatnonzero(symbols == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(powers.of_byte[symbols] * powers.up[: len(symbols)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers.down[starts]
    found = (found ^ (found >> np.uint64(32))) * _ODD
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        found[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    # Top bit off: a negative number marks a free slot of a table.
    return (found >> np.uint64(1)).view(np.int64)


def _sliced(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys together; keys sorted."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _summed([np.unique(grams(part)[0], return_counts=True) for part in _sliced(texts)])


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of all texts, with hash and count."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(text.split())
    names = list(counts)
    return names, word_hashes(b" ".join(names)), np.array(list(counts.values()), np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: sorted and small ones then compress well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def _numbers(parts: list[bytes | None], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    found = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(size, -1).T).view(kind).ravel() for p in parts if p]
    return np.concatenate(found) if found else np.zeros(0, kind)


_ASKED = pa.schema(
    [("block", pa.int64()), ("shard", pa.int32()), ("grams", pa.binary()), ("gram_counts", pa.binary()), ("words", pa.binary()), ("word_counts", pa.binary())]
)
_ASKED_SQL = "block long, shard int, grams binary, gram_counts binary, words binary, word_counts binary"


def _asked(block: int, learned: list[bytes], others: list[bytes], shards: int) -> pa.RecordBatch:
    """What one block has: its grams and words with their counts in the learned texts, by shard.

    A shard's words are joined by line feeds, which no word holds.
    """
    names, hashes, numbers = _words(learned)
    more, more_hashes, _ = _words(others)
    known = set(names)
    new = [i for i, name in enumerate(more) if name not in known]
    names += [more[i] for i in new] + [END_WORD]
    hashes = np.concatenate([hashes, more_hashes[new], [0]])
    numbers = np.concatenate([numbers, np.zeros(len(new), np.int64), [len(learned)]])
    word_order = np.argsort(hashes % shards, kind="stable")
    word_edges = np.searchsorted((hashes % shards)[word_order], np.arange(shards + 1))
    names, numbers = [names[i] for i in word_order.tolist()], numbers[word_order]
    keys, counts = _counted(learned)
    more = _counted(others)[0]
    more = more[~np.isin(more, keys)]
    keys = np.concatenate([keys, more])
    counts = np.concatenate([counts, np.zeros(len(more), np.int64)])
    shard = ((keys.view(np.uint64) * _ODD >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    keys, counts = keys[order], counts[order]
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [
        (
            block,
            i,
            _planes(keys[edges[i] : edges[i + 1]]),
            _planes(counts[edges[i] : edges[i + 1]].astype(np.uint32)),
            b"\n".join(names[word_edges[i] : word_edges[i + 1]]) if word_edges[i] < word_edges[i + 1] else None,
            numbers[word_edges[i] : word_edges[i + 1]].tobytes(),
        )
        for i in range(shards)
        if edges[i] < edges[i + 1] or word_edges[i] < word_edges[i + 1]
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)


def _asks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = None, ([], [])
        for batch in batches:
            for block, out, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now:
                    if now is not None:
                        yield _asked(now, *texts, shards)
                    now, texts = block, ([], [])
                    release()
                texts[bool(out)].append(data)
        if now is not None:
            yield _asked(now, *texts, shards)
        texts = ([], [])
        release()

    return run


def _words_of(data: bytes | None) -> list[bytes]:
    return [] if data is None else data.split(b"\n")


def _count_words(asks: pa.Table) -> pa.Table:
    """Answers to one shard: the words of each block with their counts in all blocks."""
    counts: dict[bytes, int] = {}
    rows = [(block, words) for block, words in zip(asks["block"].to_pylist(), asks["words"].to_pylist())]
    for (_, words), numbers in zip(rows, asks["word_counts"].to_pylist()):
        for word, n in zip(_words_of(words), np.frombuffer(numbers, np.int64).tolist()):
            counts[word] = counts.get(word, 0) + n
    found = [np.fromiter(map(counts.__getitem__, _words_of(w)), np.int64).tobytes() for _, w in rows]
    # The shard's sums stand in its first row.
    rest = [0] * (len(rows) - 1)
    return pa.table(
        {
            "block": pa.array([b for b, _ in rows], pa.int64()),
            "words": pa.array([w for _, w in rows], pa.binary()),
            "word_counts": pa.array(found, pa.binary()),
            "total": pa.array([sum(counts.values()), *rest], pa.int64()),
            "kinds": pa.array([sum(1 for n in counts.values() if n), *rest], pa.int64()),
        }
    )


def _count_grams(asks: pa.Table) -> pa.Table:
    """One shard's grams, each once, with their counts in all blocks."""
    keys = _numbers(asks["grams"].to_pylist(), np.int64)
    numbers = _numbers(asks["gram_counts"].to_pylist(), np.uint32)
    found, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, numbers, len(found)).astype(np.int64)
    shard = np.full(len(found), asks["shard"][0].as_py(), np.int32)
    return pa.table({"shard": shard, "gram": found, "c": counts})


def _answer_grams(asks: pa.Table, values: pa.Table) -> pa.Table:
    """The values of each block's grams."""
    keys, value = values["gram"].to_numpy(), values["value"].to_numpy().astype(np.float32)
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    rows = asks["grams"].to_pylist()
    found = [_planes(value[np.searchsorted(keys, _numbers([r], np.int64))]) for r in rows]
    return pa.table({"block": asks["block"], "grams": pa.array(rows, pa.binary()), "values": pa.array(found, pa.binary())})


def _low(column, symbols: int):
    """The last `symbols` symbols of a key."""
    return column.bitwiseAND(F.lit((1 << WIDTH * symbols) - 1))


def _context(column):
    return F.shiftright(column, WIDTH)


def trie(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Entries (key, c) and contexts (context, seen, e, g, d) of each order, from (gram, c).

    `c` is twice the count less one, what method D leaves to the symbol. `seen` is the denominator without exclusion, `e` the logarithm of the escape from it,
    `d` the denominator in the next shorter context once this one's symbols are excluded, and
    `g` the summed logarithms of the escapes from the shorter contexts under exclusion.
    Orders 0 and 1 have at most 257 and 257 ** 2 entries and are broadcast.
    """
    entries = [counts.select(F.col("gram").alias("key"), (F.col("c") * 2 - 1).alias("c"))]
    for order in range(ORDER - 1, -1, -1):
        entries.insert(
            0,
            saved(
                entries[0]
                .groupBy(_low(F.col("key"), order + 1).alias("key"))
                .agg((F.count("*") * 2 - 1).alias("c")),
                "entries",
            ),
        )
    contexts: list[DataFrame] = []
    for order, table in enumerate(entries):
        own = table.select(_context(F.col("key")).alias("context"), _low(F.col("key"), order).alias("shorter"), "c")
        if not order:
            root = own.groupBy("context").agg(F.sum("c").alias("t"), F.count("*").alias("u"))
            found = root.select("context", "t", "u", F.lit(0.0).alias("g"), F.lit(1.0).alias("d"))
        else:
            less = entries[order - 1].select(F.col("key").alias("shorter"), F.col("c").alias("less"))
            above = contexts[order - 1].select(
                F.col("context").alias("above"), F.col("t").alias("at"), F.col("u").alias("au"), F.col("g").alias("ag")
            )
            bound = order <= 2
            mine = (
                own.join(F.broadcast(less) if bound else less, "shorter")
                .groupBy("context")
                .agg(F.sum("c").alias("t"), F.count("*").alias("u"), F.sum("less").alias("gone"))
                .withColumn("above", _low(F.col("context"), order - 1))
            )
            fresh = F.col("au") - F.col("u")
            found = (
                mine.join(F.broadcast(above) if bound else above, "above")
                .withColumn("d", (F.col("at") - F.col("gone") + fresh).cast("double"))
                .withColumn("g", F.col("ag") + F.when(fresh > 0, F.log10(fresh / F.col("d"))).otherwise(F.lit(0.0)))
                .select("context", "t", "u", "g", "d")
            )
        contexts.append(
            saved(
                found.withColumn("seen", (F.col("t") + F.col("u")).cast("double")).withColumn(
                    "e", F.log10(F.col("u") / F.col("seen"))
                ),
                "contexts",
            )
        )
    return entries, contexts


def gram_scores(counts: DataFrame) -> DataFrame:
    """(shard, gram, value): the logarithm of each symbol's probability, from (shard, gram, c), c 0 if unseen."""
    seen = counts.filter("c > 0")
    entries, contexts = trie(seen)
    top = contexts[ORDER]
    known = seen.withColumn("context", _context(F.col("gram"))).join(top.select("context", "seen"), "context")
    direct = known.select("shard", "gram", F.log10((F.col("c") * 2 - 1) / F.col("seen")).alias("value"))
    missing = counts.filter("c = 0").select("shard", "gram")
    for order in range(ORDER, -1, -1):
        key = _low(F.col("gram"), order + 1)
        context = contexts[order].select(
            F.col("context").alias(f"context{order}"),
            *[F.col(x).alias(f"{x}{order}") for x in ("e", "g", "d", "seen")],
        )
        missing = missing.withColumn(f"context{order}", _context(key))
        missing = missing.join(F.broadcast(context) if order < 2 else context, f"context{order}", "left")
        if order < ORDER:
            entry = entries[order].select(F.col("key").alias(f"key{order}"), F.col("c").alias(f"c{order}"))
            missing = missing.withColumn(f"key{order}", key)
            missing = missing.join(F.broadcast(entry) if order < 2 else entry, f"key{order}", "left")
    longest = F.coalesce(*[F.when(F.col(f"e{k}").isNotNull(), F.lit(k)) for k in range(ORDER, -1, -1)])
    matched = F.coalesce(*[F.when(F.col(f"c{k}").isNotNull(), F.lit(k)) for k in range(ORDER - 1, -1, -1)], F.lit(-1))
    at = lambda name, k: F.coalesce(*[F.when(k == i, F.col(f"{name}{i}")) for i in range(ORDER + 1)])
    left = contexts[0].select("u").collect()
    # With all symbols seen at order 0 none is left for the last escape.
    rest = max(SYMBOLS - (left[0]["u"] if left else 0), 1)
    m, j = F.col("m"), F.col("j")
    count = F.coalesce(*[F.when(j == k, F.col(f"c{k}")) for k in range(ORDER)])
    value = (
        F.when(m.isNull(), F.lit(1 / SYMBOLS).cast("double"))
        .when(m == j, F.log10(count / at("seen", m)))
        .when(j < 0, at("e", m) + at("g", m) - F.log10(F.lit(float(rest))))
        .otherwise(at("e", m) + at("g", m) - at("g", j + 1) + F.log10(count / at("d", j + 1)))
    )
    value = F.when(m.isNull(), -F.log10(F.lit(float(SYMBOLS)))).otherwise(value)
    return direct.unionByName(missing.withColumns({"m": longest, "j": matched}).select("shard", "gram", value.alias("value")))


class Table:
    """Values by 64-bit key in an open-addressed table, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        out = self.values[slots]
        rest = np.flatnonzero(self.keys[slots] != keys)
        slots = slots[rest]
        while len(rest):
            slots = (slots + 1) & self.mask
            hit = self.keys[slots] == keys[rest]
            out[rest[hit]] = self.values[slots[hit]]
            rest, slots = rest[~hit], slots[~hit]
        return out


def _scores(total: int, kinds: int, schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names, numbers = [], []
        for words, found in zip(answers["words"].to_pylist(), answers["word_counts"].to_pylist()):
            names += _words_of(words)
            numbers.append(np.frombuffer(found or b"", np.int64))
        counted = dict(zip(names, np.concatenate(numbers).tolist()))
        ends = counted.pop(END_WORD)
        names = list(counted)
        of_word = np.fromiter(counted.values(), np.float64, len(names))
        hashes = word_hashes(b" ".join(names))
        one_by_one = len(np.unique(hashes)) < len(names)
        words_table = Table(hashes, of_word)
        table = Table(
            _numbers(answers["grams"].to_pylist(), np.int64),
            _numbers(answers["values"].to_pylist(), np.float32),
        )
        del answers, numbers
        of_end = np.log10((ends + 1) / (total + kinds + 1))
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for part in _sliced(docs.column("data").to_pylist()):
            keys, starts = grams(part)
            out["score"].append(np.add.reduceat(table(keys), starts[:-1]))
            if one_by_one:
                found = np.array([counted[w] for text in part for w in text.split()], np.float64)
            else:
                found = words_table(word_hashes(b" ".join(t for t in part if t)))
            sizes = np.array([t.count(b" ") + 1 if t else 0 for t in part])
            edges = np.concatenate(([0], np.cumsum(sizes)))
            logs = np.log10((found + 1) / (total + kinds + 1))
            # Each text's own sum: reduceat over its words, none for an empty one.
            own = np.zeros(len(part))
            some = sizes > 0
            if some.any():
                own[some] = np.add.reduceat(logs, edges[:-1][some])
            known = np.concatenate(([0], np.cumsum(found > 0)))
            out["n_tokens"].append(sizes + 1)
            out["n_known"].append(known[edges[1:]] - known[edges[:-1]] + int(ends > 0))
            out["base_score"].append(own + of_end)
        del table, words_table, counted, names
        release()
        out = {k: np.concatenate(v) for k, v in out.items()}
        n = docs.num_rows
        return pa.Table.from_arrays(
            [
                docs.column("doc_id").cast(schema.field(0).type),
                docs.column("held_out"),
                pa.array(out["n_tokens"], pa.int64()),
                pa.array(out["n_known"], pa.int64()),
                pa.array(np.full(n, total, np.int64)),
                pa.array(out["base_score"], pa.float64()),
                pa.array(out["score"], pa.float64()),
            ],
            schema=schema,
        )

    return run


def score_texts(docs: DataFrame, parts: int = 7, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Learned from the documents whose id's CRC-32 does not leave `part`; all are scored. Null
    and empty texts are one end token, and repeated rows come out each. With no document to
    learn from every symbol has the same probability. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    rows = blocks(documents(docs, id_col, text_col), parts, part)
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.select("block").distinct().count() // 4)
    asks = saved(rows.select("block", "held_out", "data").mapInArrow(_asks(shards), _ASKED_SQL), "asks")
    of_words = saved(
        asks.select("block", "shard", "words", "word_counts")
        .groupBy("shard")
        .applyInArrow(_count_words, "block long, words binary, word_counts binary, total long, kinds long"),
        "words",
    )
    size = of_words.agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).first()
    total, kinds = size["total"] or 0, size["kinds"] or 0
    counts = saved(
        asks.select("shard", "grams", "gram_counts")
        .groupBy("shard")
        .applyInArrow(_count_grams, "shard int, gram long, c long"),
        "grams",
    )
    of_grams = (
        asks.select("block", "shard", "grams")
        .groupBy("shard")
        .cogroup(gram_scores(counts).groupBy("shard"))
        .applyInArrow(_answer_grams, "block long, grams binary, values binary")
    )
    answers = of_words.select("block", "words", "word_counts").unionByName(of_grams, allowMissingColumns=True)
    schema = with_id(
        rows,
        StructField("held_out", BooleanType()),
        StructField("n_tokens", LongType()),
        StructField("n_known", LongType()),
        StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()),
        StructField("score", DoubleType()),
    )
    together = rows.groupBy("block").cogroup(answers.groupBy("block"))
    return together.applyInArrow(_scores(total, kinds, to_arrow_schema(schema)), schema)
