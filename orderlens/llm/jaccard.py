"""N-gram Jaccard join: size-aware, heavy and light sets apart, exact.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class from
the start. Elements have one order for all sets, rare ones first. Of two sets with the
similarity, the first `p` elements of each (p follows from the size) share one, and the first
p + 1 share two.

More generally the first p + k - 1 share k. So a set goes on only if so many of its first elements
are on lists of several sets as every set that it can link to would need: most sets without a near
copy are done here, before any pair is made, whatever their number.

* Light sets, up to a boundary in size, enumerate all 2-subsets of their first p + 1 elements.
  Two light sets that link have such a subset in common, and few others do.
* Heavy sets would have too many subsets: they go on inverted lists under their first p
  elements, with the light sets that are large enough to link to one of them.

The boundary is where the subsets to write and the lists to scan cost least together. Elements
that one set alone has are left out of both.

Of a list with up to SHORT members all pairs are candidates. The members of a longer list are
compared by signatures where the list is, and each names a bounded number of earlier members that
it may link to; it goes on after those in the next round, unless all that is left is joined to it
by then. So a large group of near copies costs a few candidates a member, members that link to
nothing are done in one round, and no link between unjoined texts is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from orderlens.llm.common import documents, join_hot, prepare, release, saved, with_id
from orderlens.llm.exact_dedup import may_repeat
from orderlens.llm.simhash import components

WORDS = 4
PERCENT = 85
# Counters that tell how common an element is, and the counters of one row of them.
COUNTERS = 1 << 20
SLICE = 1 << 16
# Rows of counters that are added up at once.
ADDED = 64
# Sets larger than this are heavy, whatever the costs.
MOST_LIGHT = 4096
# The least bits of a set's parity signature. Larger sets have a bit for each element or more.
SIGNATURE = 512
# Members of a list whose pairs are all compared at once.
SHORT = 16
# Earlier members that a member of a longer list names in the rounds; the last number goes on.
HUBS = (1, 256)
# Members that are compared with as many others at once.
BLOCK = 512
# Lists that a member of a longer list knows itself to be on, and those that a list's members are told apart by.
KNOWN, TOLD = 32, 512
# Rows of an Arrow batch where rows are a few numbers.
NARROW = 1 << 16
# Pairs of one hub that meet its set in one place.
DEALT = 1024
# Words of a text that are hashed at once.
CHUNK = 1 << 16

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


class Powers:
    """Powers of the base and of its inverse, as many as a text has needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base)))) for base in (_BASE, inverse)
            )
        return self.up[:n], self.down[:n]


class Hasher:
    """Shingle sets of texts.

    A shingle's hash is that of its words with one blank between, a polynomial in a 64-bit base
    over random numbers for its bytes: the difference of two sums over the text, mixed.
    """

    def __init__(self, words: int):
        self.words = words
        self.powers = Powers()

    def elements(self, text: str) -> np.ndarray:
        """The distinct shingles of a text as sorted hashes."""
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        n = min(self.words, len(found))
        parts = [self._hashes(found[i : i + CHUNK + n - 1], n) for i in range(0, len(found) - n + 1, CHUNK)]
        out = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out

    def _hashes(self, found: list[bytes], n: int) -> np.ndarray:
        line = np.frombuffer(b" ".join([*found, b""]), np.uint8)
        ends = np.flatnonzero(line == 32)
        up, down = self.powers.to(len(line))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[line] * up)))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - n + 1]
        out = (sums[ends[n - 1 :]] - sums[starts]) * down[starts]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            yield doc_id, text.as_py()


def _counters(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(words), np.zeros(COUNTERS, np.int64)
        for _, text in _texts(batches):
            np.add.at(counts, _counter(hasher.elements(text)), 1)
        rows = counts.reshape(-1, SLICE)
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(range(len(rows)), pa.int64()), "counts": [row.tobytes() for row in rows]}
        )
        release()

    return run


def _counter(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.int64)
    for counts in group["counts"]:
        total += np.frombuffer(counts, np.int64)
    return pd.DataFrame(
        {"slice": [group["slice"].iloc[0]], "part": [group["part"].iloc[0]], "counts": [total.tobytes()]}
    )


def commonness(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many times the mean each counter holds, as powers of two.

    Only the order of elements depends on it, never a result: its fixed size makes it coarser
    on more data.
    """
    counted = texts.mapInArrow(_counters(words), "slice long, counts binary")
    rows = saved(counted.withColumn("part", F.spark_partition_id()), "counters")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # The rows of one slice are added in groups of a bounded number.
        parts = -(-parts // ADDED)
        grouped = rows.withColumn("part", F.expr(f"part div {ADDED}")).groupBy("slice", "part")
        rows = saved(grouped.applyInPandas(_added, "slice long, part long, counts binary"), "counters")
        if parts == 1:
            break
    total = np.zeros(COUNTERS, np.int64)
    for row in rows.collect():  # one row per slice: 8 MB in all
        total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    mean = max(float(total.mean()), 1.0)
    return np.log2(np.maximum(total / mean, 1)).astype(np.uint8)


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of this size shares at least with any set it links to."""
    return -(-percent * n // 100)


def reach(n: int, percent: int) -> int:
    """`p`: of the first so many elements of a set, one is shared with any set it links to."""
    return n - least_overlap(n, percent) + 1


def in_common(n: int, percent: int) -> int:
    """`k`: of the first p + k - 1 elements of a set, its own k and those of any set it links to are shared."""
    return min(max(2, 1 + reach(n, percent) // 4), least_overlap(n, percent))


def can_link(n: int, percent: int) -> bool:
    """Whether a set of this size can link to one that differs from it."""
    return 100 * n >= percent * (n + 1)


def signature(elements: np.ndarray, places: int = 0) -> np.ndarray:
    """Parities of the elements by places, a power of two of them.

    Of two sets, no more places differ than elements are in one of them alone. A signature is
    folded to half its places by the exclusive or of its halves.
    """
    places = places or max(SIGNATURE, 1 << (len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(shared, words: int, percent: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, common = Hasher(words), shared.value
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in _texts([batch]):
                elements = hasher.elements(text)
                n = len(elements)
                if not n:
                    rows.append((doc_id, 0, None, None, None))
                    continue
                digest = hashlib.sha256(elements.tobytes()).digest()
                first = None
                if can_link(n, percent):
                    # Sorted already, so equally common elements stay in the order of hashes.
                    order = np.argsort(common[_counter(elements)], kind="stable")[: reach(n, percent) + in_common(n, percent) - 1]
                    first = elements[order].view(np.int64)
                rows.append((doc_id, n, digest, first, signature(elements)))
            columns = [pa.array(list(values), field.type) for values, field in zip(zip(*rows), schema)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release()

    return run


def describe(texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: n, digest of the set, first elements, signature."""
    from pyspark.sql.pandas.types import to_arrow_schema

    common = commonness(texts, words)
    schema = with_id(
        texts,
        StructField("n", LongType()),
        StructField("digest", BinaryType()),
        StructField("first", ArrayType(LongType())),
        StructField("signature", ArrayType(LongType())),
    )
    shared = texts.sparkSession.sparkContext.broadcast(common)
    return texts.mapInArrow(_described(shared, words, percent, to_arrow_schema(schema)), schema)


def boundary(classes: DataFrame, lists: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets are light: subsets to write and lists to scan cost least.

    `lists` are the repeated lists of all sets, one row per member with the list's size: a
    member's scan costs the other members.
    """
    size = F.least("n", F.lit(MOST_LIGHT + 1)).alias("n")
    sets = classes.filter("first IS NOT NULL").groupBy(size).agg(F.count("*").alias("cost")).collect()
    scans = lists.groupBy(size).agg(F.sum(F.col("size") - 1).alias("cost")).collect()
    # MOST_LIGHT + 1 rows at most, each.
    write, scan = np.zeros(MOST_LIGHT + 2), np.zeros(MOST_LIGHT + 2)
    for row in sets:
        m = reach(row["n"], percent) + 1
        write[row["n"]] = row["cost"] * m * (m - 1) / 2
    for row in scans:
        scan[row["n"]] = row["cost"]
    light = np.cumsum(write)[: MOST_LIGHT + 1]
    below = np.concatenate(([0.0], np.cumsum(scan)))
    heavy = [below[-1] - below[least_overlap(x + 1, percent)] for x in range(MOST_LIGHT + 1)]
    return int(np.argmin(light + np.array(heavy)))


# Of a set of n elements, in SQL: `least_overlap`, `reach` and `in_common`.
def _least(n: str, percent: int) -> str:
    return f"(({percent}L * {n} + 99) div 100)"


def _reach(n: str, percent: int) -> str:
    return f"({n} - {_least(n, percent)} + 1)"


def _in_common(n: str, percent: int) -> str:
    return f"least(greatest(2, 1 + {_reach(n, percent)} div 4), {_least(n, percent)})"


# The least form of a signature.
_WORDS = SIGNATURE // 64
_MARK = (
    f"transform(sequence(0, {_WORDS - 1}), i -> aggregate(sequence(i, size(signature) - 1, {_WORDS}), 0L, "
    "(s, j) -> s ^ signature[j]))"
)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys, those whose key another row has."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, at, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        known = np.zeros(len(key), bool)
        if last:
            key, at, pos, known = (np.concatenate(both) for both in zip(last, (key, at, pos, known)))
        same = key[1:] == key[:-1]
        known[1:] |= same
        known[:-1] |= same
        last = tuple(column[-1:] for column in (key, at, pos, known))
        found = known[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][found]) for c in (key, at, pos)], names=["key", "class", "pos"])
    if last and last[3][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[:3]], names=["key", "class", "pos"])


def _held(classes: DataFrame, percent: int) -> DataFrame:
    """The classes that can link to others; `first` has (pos, key) of the elements that several classes have.

    `pos` is the place of an element in its set's order. A set that links shares as many elements as
    the smallest set that it can link to asks for.
    """
    conf = classes.sparkSession.conf
    keyed = classes.filter("first IS NOT NULL").select("class", F.posexplode("first").alias("pos", "key"))
    sorted_ = keyed.select("key", "class", "pos").repartition("key").sortWithinPartitions("key")
    rows = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW))
    try:
        several = saved(sorted_.mapInArrow(_several, "key long, class long, pos int"), "several")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    met = several.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("first"))
    asked = _in_common(_least("n", percent), percent)
    among = f"size(filter(first, x -> x.pos < {_reach('n', percent)} + {asked} - 1))"
    return saved(met.filter("size(first) > 1").join(classes.drop("first"), "class").filter(f"{among} >= {asked}"), "held")


# (key, pos) of the first p elements, and of the 2-subsets of the first p + 1; `pos` is of the first of two.
def _singles(percent: int) -> str:
    return f"transform(filter(first, x -> x.pos < {_reach('n', percent)}), x -> struct(x.key, x.pos))"


def _pairs(percent: int) -> str:
    few = f"filter(first, x -> x.pos <= {_reach('n', percent)})"
    return (
        f"flatten(transform({few}, (x, i) -> transform(filter({few}, y -> y.pos > x.pos), "
        "y -> struct(xxhash64(x.key, y.key) AS key, x.pos))))"
    )


def _lists(held: DataFrame, keys: str, rare: bool = False) -> DataFrame:
    """(key, class, n, pos, size) of the keys that several classes have; `rare` if most keys are of one class."""
    keyed = held.select("class", F.col("n").cast("int").alias("n"), F.explode(F.expr(keys)).alias("k"))
    keyed = keyed.select("k.key", "class", "n", "k.pos")
    if rare:
        keyed = saved(keyed, "keyed")
        keyed = keyed.filter(may_repeat(keyed.select("key"))("key"))
    size = F.count("*").over(Window.partitionBy("key"))
    return saved(keyed.withColumn("size", size).filter("size > 1"), "lists")


def _all_lists(held: DataFrame, light: int | None, percent: int) -> DataFrame:
    met = _lists(held, _singles(percent))
    light = boundary(held, met, percent) if light is None else light
    if not light:
        return met
    heavy = met.filter(F.col("n") >= least_overlap(light + 1, percent))
    return heavy.unionByName(_lists(held.filter(F.col("n") <= light), _pairs(percent), rare=True))


def _fits(x: str, y: str, percent: int) -> str:
    """Whether sizes and places allow two members of a list to have the similarity."""
    least, most = f"least({x}.n, {y}.n)", f"greatest({x}.n, {y}.n)"
    shared = f"(least({x}.pos, {y}.pos) + 1 + least({x}.n - {x}.pos, {y}.n - {y}.pos) - 1)"
    return (
        f"100L * {least} >= {percent}L * {most} AND 100L * {shared} >= {percent}L * ({least} + {most} - {shared})"
    )


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the lists with up to SHORT members."""
    grouped = lists.filter(F.col("size") <= SHORT).groupBy("key").agg(
        F.collect_list(F.struct("class", "n", "pos")).alias("held")
    )
    later = f"filter(slice(held, i + 2, {SHORT}), y -> {_fits('held[i]', 'y', percent)})"
    pairs = (
        f"flatten(transform(sequence(0, size(held) - 2), i -> transform({later}, y -> "
        "struct(least(held[i].class, y.class) AS a, greatest(held[i].class, y.class) AS b))))"
    )
    grouped = grouped.filter(F.size("held") > 1)
    return grouped.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b").distinct()


def _members(lists: DataFrame, held: DataFrame) -> DataFrame:
    """(key, class, n, pos, mark, liked, before, root, next) of the longer lists; at first a class is its own root.

    `liked` puts first what is on many lists with many others: the text that the others of a
    group were made from, where it is there. `before` has longer lists with a smaller key that the
    class is on: classes that meet there are compared there. `next` is the first place of the list that
    the class is still to be compared with.
    """
    long_ = lists.filter(F.col("size") > SHORT)
    liked = long_.groupBy("class").agg((-F.sum("size")).alias("liked"), F.collect_set("key").alias("keys"))
    liked = liked.withColumn("keys", F.slice(F.array_sort("keys"), 1, KNOWN))
    liked = liked.join(held.select("class", F.expr(_MARK).alias("mark")), "class")
    met = long_.drop("size").join(liked, "class")
    met = met.withColumn("before", F.expr("filter(keys, x -> x < key)")).drop("keys")
    return saved(met.withColumn("root", F.col("class")).withColumn("next", F.lit(0)), "members")


def _bits(before: list[np.ndarray]) -> np.ndarray:
    """Of each member a bit for each of the lists that most of the members have been on before."""
    flat = np.concatenate(before)
    lists, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(lists), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(lists))
    member, bit = np.repeat(np.arange(len(before)), [len(b) for b in before]), rank[at]
    member, bit = member[bit < TOLD], bit[bit < TOLD]
    out = np.zeros((len(before), -(-min(max(len(lists), 1), TOLD) // 64)), np.uint64)
    np.bitwise_or.at(out, (member, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _named(most: int, percent: int):
    """Of one list: pairs (a, b) that may link (next < 0), and `next` of the classes (a) that are not done."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["liked", "class"])
        name, n, pos, root = (group[c].to_numpy(np.int64) for c in ("class", "n", "pos", "root"))
        after, marks = group["next"].to_numpy(np.int64).copy(), np.stack(group["mark"].to_list()).view(np.uint64)
        bits = _bits(group["before"].to_list())
        found: list[np.ndarray] = []
        left: list[np.ndarray] = []
        for start in range(0, len(name), BLOCK):
            # Members of this block (rows of the tables) with earlier ones (columns), block by block.
            at = np.arange(start, min(start + BLOCK, len(name)))
            at = at[after[at] < at]
            named = np.zeros(len(at), np.int64)
            for low in range(0, start + 1, BLOCK):
                if not len(at):
                    break
                to = np.arange(low, min(low + BLOCK, len(name)))
                x, y = at[:, None], to[None, :]
                near = (y < x) & (y >= after[x]) & (root[x] != root[y])
                least, both = np.minimum(n[x], n[y]), n[x] + n[y]
                same = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
                near &= (100 * least >= percent * (both - least)) & (100 * same >= percent * (both - same))
                i, j = np.nonzero(near)
                differ = np.bitwise_count(marks[at[i]] ^ marks[to[j]]).sum(axis=1, dtype=np.int64)
                sizes = both[i, j]
                near[i, j] = 100 * (sizes - differ) >= percent * (sizes + differ)
                # A pair is left to the first list that both are known to be on.
                i, j = np.nonzero(near)
                near[i, j] = ~(bits[at[i]] & bits[to[j]]).any(axis=1)
                place = named[:, None] + np.cumsum(near, axis=1)
                i, j = np.nonzero(near & (place <= most))
                found.append(np.stack([name[at[i]], name[to[j]]]))
                # What has named all that it may goes on after the last of those.
                full = place[:, -1] >= most
                on = to[np.argmax(place[full] >= most, axis=1)] + 1
                left.append(np.stack([name[at[full]], on])[:, on < at[full]])
                at, named = at[~full], place[~full, -1]
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        class_, on = np.concatenate(left, axis=1) if left else np.empty((2, 0), np.int64)
        rows = {
            "a": np.concatenate([np.minimum(a, b), class_]),
            "b": np.concatenate([np.maximum(a, b), class_]),
            "next": np.concatenate([np.full(len(a), -1), on]).astype(np.int32),
        }
        return pd.DataFrame({"key": group["key"].iloc[0], **rows})

    return run


def _still(members: DataFrame, left: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the lists with a class that is not done and that are not all joined; their roots and places."""
    asked = saved(left.select("key").distinct(), "asked")
    narrow = members.select("key", "class").join(asked, "key", "left_semi")
    narrow = narrow.join(left.withColumnRenamed("a", "class"), ["key", "class"], "left")
    narrow = narrow.join(roots.withColumnRenamed("node", "class"), "class", "left")
    done = F.lit((1 << 31) - 1)
    narrow = narrow.select("key", "class", F.coalesce("root", "class").alias("root"), F.coalesce("next", done).alias("next"))
    narrow = saved(narrow, "places")
    by = narrow.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = narrow.join(saved(by.filter("low < high").select("key"), "open"), "key", "left_semi")
    return saved(members.drop("root", "next").join(open_, ["key", "class"]), "members")


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow the similarity."""
    held = classes.select("class", "n", "signature")
    load = pairs.groupBy("a").agg(F.count("*").alias("load"))
    left = held.toDF("a", "n_a", "signature_a").join(load, "a")
    right = held.toDF("b", "n_b", "signature_b")
    met = join_hot(pairs, saved(left, "hub_signatures"), "a", "load", "inner").join(right, "b")
    # Sizes of sets that may link differ by less than twice, so one of the two is folded once at most.
    for one, other in (("signature_a", "signature_b"), ("signature_b", "signature_a")):
        half = f"size({one}) div 2"
        met = met.withColumn(
            one,
            F.expr(
                f"CASE WHEN size({one}) > size({other}) THEN "
                f"zip_with(slice({one}, 1, {half}), slice({one}, {half} + 1, {half}), (x, y) -> x ^ y) ELSE {one} END"
            ),
        )
    differ = F.expr(
        "aggregate(zip_with(signature_a, signature_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    )
    shared = (F.col("n_a") + F.col("n_b") - differ) / 2
    met = met.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
    return saved(met.select("a", "b", "n_a", "n_b", "load"), "near_pairs")


def _elements(words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            sets = [hasher.elements(text) for _, text in _texts([batch])]
            digests = [hashlib.sha256(s.tobytes()).digest() for s in sets]
            columns = [pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], schema.field(1).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release()

    return run


def _sets(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class, set) of the given classes, made from the text of one document of each."""
    schema = pa.schema([("digest", pa.binary()), ("set", pa.list_(pa.int64()))])
    named = saved(classes.select(F.col("least").alias("doc_id")).distinct(), "named")
    found = texts.alias("t").join(named.alias("c"), F.expr("t.doc_id <=> c.doc_id"), "left_semi")
    made = found.mapInArrow(_elements(words, schema), "digest binary, set array<long>")
    # Rows that share an id may hold other sets, and the same set several times.
    met = made.join(classes.select("class", "digest"), "digest")
    return saved(met.groupBy("class").agg(F.any_value("set").alias("set")), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that have the similarity. A hub's set goes to as many places as its pairs need."""
    parts = F.expr(f"(load + {DEALT - 1}) div {DEALT}")
    dealt = pairs.withColumn("slot", F.pmod(F.xxhash64("b"), parts))
    slots = pairs.select("a", parts.alias("parts")).distinct()
    slots = saved(slots.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot")), "slots")
    hubs = slots.join(sets.toDF("a", "set_a"), "a")
    met = dealt.join(hubs, ["a", "slot"]).join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    met = met.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
    return saved(met.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")), "links")


def _joined(texts: DataFrame, classes: DataFrame, light: int | None, words: int, percent: int) -> DataFrame:
    """(node, root) of all classes that link to another."""
    held = _held(classes, percent)
    lists = _all_lists(held, light, percent)
    members = _members(lists, held)
    roots = texts.sparkSession.createDataFrame([], "node long, root long")
    pairs = _short_pairs(lists, percent)
    most = iter(HUBS)
    now = 1
    while True:
        now = next(most, now)
        kind = "key long, a long, b long, next int"
        met = saved(members.groupBy("key").applyInPandas(_named(now, percent), kind), "named")
        more = met.filter("next < 0").select("a", "b")
        pairs = saved((more if pairs is None else more.union(pairs)).distinct(), "pairs")
        near, pairs = _may_link(pairs, held, percent), None
        if not near.isEmpty():
            asked = saved(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "asked")
            wanted = saved(held.join(asked, "class", "left_semi").select("class", "digest", "least"), "wanted")
            links = _linked(near, _sets(texts, wanted, words), percent)
            if not links.isEmpty():
                # Links of earlier rounds are stars by now.
                stars = roots.filter("node > root").toDF("child", "parent")
                roots = saved(components(links.unionByName(stars)), "roots")
        left = met.filter("next >= 0").select("key", "a", "next")
        if left.isEmpty():
            return roots
        members = _still(members, left, roots)
        if members.isEmpty():
            return roots


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: class, digest, least, size, n, first, signature.

    Only sets that may have copies are shuffled; the others are classes as they are.
    """
    held = rows.filter("n > 0").withColumn("hash", F.xxhash64("digest"))
    test = may_repeat(held.select("hash"))
    folded = held.filter(test("hash")).groupBy("digest").agg(
        F.min("doc_id").alias("least"),
        F.count("*").alias("size"),
        F.min("row").alias("class"),
        *[F.any_value(name).alias(name) for name in ("n", "first", "signature")],
    )
    folded = saved(folded, "folded")
    alone = held.filter(~test("hash")).select(
        "digest", F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("size"), F.col("row").alias("class"), "n", "first", "signature"
    )
    return alone.unionByName(folded)


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    light: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_size.

    Two documents link if 100 * shared >= percent * united shingles; `percent` is over 50. The
    component is named by the smallest doc_id that links reach, null ids last. Texts without
    words, null ones too, link with nothing and are their own component (class_size 0). Of
    fewer than `words` words the whole text is one shingle. Repeated rows come out each; an
    empty table gives no rows. `light` sets the boundary, else the costs do.
    """
    if not 50 < percent <= 100:
        raise ValueError("the similarity is a percentage over 50")
    prepare(docs.sparkSession)
    texts = documents(docs, id_col, text_col)
    rows = describe(texts, words, percent).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "described")
    classes = _classes(rows)
    roots = _joined(texts, classes, light, words, percent).withColumnRenamed("node", "class")
    rooted = classes.select("class", "digest", "least", "size").join(roots, "class", "left")
    rooted = saved(rooted.withColumn("root", F.coalesce("root", "class")), "rooted")
    best = saved(
        rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "best"
    )
    placed = saved(
        join_hot(rooted.select("digest", "size", "root"), best, "root", "classes", "inner").select(
            "digest", "component_id", F.col("size").alias("class_size")
        ),
        "placed",
    )
    out = join_hot(rows.filter("n > 0").select("doc_id", "n", "digest"), placed, "digest", "class_size", "inner")
    alone = rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("class_size")
    )
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size").unionByName(alone)
