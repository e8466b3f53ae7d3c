"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve orders all vectors by the Hilbert number of a random projection, shifted by a
random offset. Equal vectors lie there once, with their smallest ids, and are asked once.
Spark range-partitions each order; runs of rows form blocks. A query searches
the blocks around its own place on every curve, and what it finds is merged and ranked by the
exact inner product. How far it looks is fitted: a bounded sample of queries is answered
exactly, and the window is the smallest that finds the wanted share of those answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from orderlens.llm.common import join_hot, saved

NEIGHBOURS = 20
CURVES = 4
# Projected dimensions and bits of each on a curve.
AXES, BITS = 8, 7
# Vectors of a block, and blocks searched by one group of a task.
BLOCK = 1024
TOGETHER = 16
# Queries that one group of a task takes, about; and those multiplied with a block at once.
ASKED = 16_384
SLICE = 256
# Bounds of the samples: vectors for the grid, queries for the window; the share to be found.
GRID_SAMPLE = 4096
QUERY_SAMPLE = 64
WANTED = 0.96
_TIE = 1e-9


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (after Skilling's transform)."""
    axes = [c.astype(np.int64) for c in cells.T]
    n = len(axes)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            up = (axes[i] & bit) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        bit >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where(axes[n - 1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    place = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((axes[i] ^ turn) >> b) & 1)
    return place


class Curves:
    """Projections, offsets and grids of all curves, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.longest = longest
        lifted = self.lift(sample)
        axes = min(AXES, lifted.shape[1])
        self.turns = [np.linalg.qr(rng.standard_normal((lifted.shape[1], axes)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, axes))
        self.grids = [np.sort(lifted @ turn, axis=0) for turn in self.turns]

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """One more component that makes all of one length: then near means a large product."""
        rest = np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def aim(self, queries: np.ndarray) -> np.ndarray:
        length = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        return np.hstack([queries * (self.longest / length), np.zeros((len(queries), 1))])

    def places(self, lifted: np.ndarray) -> Iterator[np.ndarray]:
        for turn, shift, grid in zip(self.turns, self.shifts, self.grids):
            shares = np.stack(
                [np.searchsorted(grid[:, i], x) / (len(grid) + 1) for i, x in enumerate((lifted @ turn).T)], axis=1
            )
            # Shifted within twice the range, so no cell boundary is common to all curves.
            yield hilbert(((shares + shift) / 2 * (1 << BITS)).astype(np.int64))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    vectors = rows.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(finite & F.exists("v", lambda x: x != 0))


def _folded(base: DataFrame, query_step: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Each vector once, and (h, query_id) of all queries.

    A vector comes with a key, its hash, its k + 1 smallest ids (of ties the smaller ids count,
    and one may be the query itself) and the number of its queries. No group of equal vectors
    meets in one task: ids are limited by task before they are shuffled.
    """
    base = base.withColumn("h", F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v"))))
    members = saved(base.select("h", "id").distinct(), "members")
    least = (
        members.withColumn("place", F.row_number().over(W.partitionBy("h").orderBy("id")))
        .filter(F.col("place") <= k + 1)
        .groupBy("h")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    queries = members.filter(F.col("id") % query_step == 0)
    asked = queries.groupBy("h").agg(F.count("*").alias("n"))
    vectors = base.groupBy("h").agg(F.first("v").alias("v")).join(least, "h").join(asked, "h", "left")
    # The key is written, so it stays the same.
    keyed = vectors.select(F.monotonically_increasing_id().alias("key"), "h", "v", "ids", F.coalesce("n", F.lit(0)).alias("n"))
    return saved(keyed, "folded"), queries.select("h", F.col("id").alias("query_id"))


def _placed(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curves = shared.value
        for frame in frames:
            if not len(frame):
                continue
            vectors, keys = np.stack(frame["v"].to_numpy()), frame["key"].to_numpy()
            asks = frame["n"].to_numpy() > 0
            data = [v.tobytes() for v in vectors]
            ids = [np.asarray(i, np.int64).tobytes() for i in frame["ids"]]
            for rows, query, lifted in (
                (np.arange(len(keys)), False, curves.lift(vectors)),
                (np.flatnonzero(asks), True, curves.aim(vectors[asks])),
            ):
                for curve, places in enumerate(curves.places(lifted)):
                    yield pd.DataFrame(
                        {
                            "curve": curve,
                            "place": places,
                            "query": query,
                            "key": keys[rows],
                            "ids": [b"" if query else ids[i] for i in rows],
                            "v": [data[i] for i in rows],
                        }
                    )

    return run


def _blocked(size: int):
    """Rows in curve order to blocks of `size` vectors; each query gets the block that it falls into.

    A block is one row or, if more than `size` queries fall into it, several under one number,
    with at most `size` queries each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, on, filled = TaskContext.get().partitionId() << 32, None, 0
        held: list[pd.DataFrame] = []

        def whole(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal block, on, filled, held
            rows = pd.concat(held) if held else pd.DataFrame()
            while len(rows):
                curve = rows["curve"].iloc[0]
                own = rows["curve"].to_numpy() == curve
                asked = rows["query"].to_numpy()[: len(rows) if own.all() else int(np.argmin(own))]
                here = filled if curve == on and (filled < size or asked[0]) else 0
                cut = min(
                    int(np.searchsorted(np.cumsum(~asked), size - here + 1)),
                    int(np.searchsorted(np.cumsum(asked), size + 1)),
                )
                if cut == len(rows) and not last:
                    break
                if on is not None and (curve != on or here != filled):
                    block += 1
                on = curve
                piece, rows = rows.iloc[:cut], rows.iloc[cut:]
                vectors, asks = piece[~piece["query"]], piece[piece["query"]]
                filled = here + len(vectors)
                yield pd.DataFrame(
                    {
                        "curve": curve,
                        "block": block,
                        "ids": [b"".join(vectors["ids"])],
                        "counts": [(vectors["ids"].map(len).to_numpy(np.int64) // 8).tobytes()],
                        "vectors": [b"".join(vectors["v"])],
                        "keys": [asks["key"].to_numpy(np.int64).tobytes()],
                        "queries": [b"".join(asks["v"])],
                    }
                )
            held = [rows] if len(rows) else []

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) > 4 * size:
                yield from whole(False)
        yield from whole(True)

    return run


_BLOCK_TYPE = "curve int, block long, ids binary, counts binary, vectors binary, keys binary, queries binary"


def ranked(queries: np.ndarray, keys: np.ndarray, vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int):
    """(key, id, score) of each query's best k here; ties to smaller ids.

    `ids` has the ids of each vector one after the other, `counts` how many are whose. A matrix
    product selects; scores are then summed component by component, so that vectors of equal
    scores have them wherever they lie. An id of several vectors has the best score of them and
    takes one place; at least k ids reach the k-th best of the vectors' first ids.
    """
    rough = queries @ vectors.T
    starts = np.cumsum(counts) - counts
    order = np.argsort(ids[starts], kind="stable")
    change = np.flatnonzero(np.diff(ids[starts][order], prepend=ids[starts][order[0]] - 1))
    each = rough if len(change) == len(order) else np.maximum.reduceat(rough[:, order], change, axis=1)
    keep = min(k, len(change))
    least = np.partition(each, len(change) - keep, axis=1)[:, len(change) - keep]
    slack = _TIE * (1 + np.abs(least))
    q, at = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
    score = np.zeros(len(q))
    for d in range(vectors.shape[1]):
        score += queries[q, d] * vectors[at, d]
    many = counts[at]
    own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return _first(keys[np.repeat(q, many)], ids[np.repeat(starts[at], many) + own], np.repeat(score, many), k)


def _first(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The best k ids of each key; an id that comes more than once has its best score."""
    order = np.lexsort((-scores, ids, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[new]
    order = order[np.lexsort((ids[order], -scores[order], keys[order]))]
    keys, ids, scores = keys[order], ids[order], scores[order]
    best = np.arange(len(keys)) - np.searchsorted(keys, keys) < k
    return keys[best], ids[best], scores[best]


def _searched(dim: int, k: int, reach: int):
    """Each query's best in the blocks of one stretch that lie within its reach."""

    def run(blocks: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(blocks) and len(asks):
            queries = np.frombuffer(b"".join(asks["queries"])).reshape(-1, dim)
            keys = np.frombuffer(b"".join(asks["keys"]), np.int64)
            homes = np.repeat(asks["home"].to_numpy(), [len(x) // 8 for x in asks["keys"]])
            for at in range(0, len(keys), SLICE):
                asked, own, home = (x[at : at + SLICE] for x in (queries, keys, homes))
                part = []
                for number, ids, counts, vectors in zip(blocks["number"], blocks["ids"], blocks["counts"], blocks["vectors"]):
                    ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
                    near = np.abs(home - number) <= reach
                    if len(ids) and near.any():
                        here = np.frombuffer(vectors).reshape(-1, dim)
                        part.append(ranked(asked[near], own[near], here, ids, counts, k))
                # The best of all blocks together.
                if part:
                    found.append(_first(*(np.concatenate(c) for c in zip(*part)), k))
        best = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame(dict(zip(("key", "vec_id", "score"), best)))

    return run


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy(key, "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def _window(numbered: DataFrame, folded: DataFrame, queries: DataFrame, dim: int, k: int) -> int:
    """Blocks to either side that find WANTED of the exact answers of a sample of all queries."""
    spark = numbered.sparkSession
    sample = queries.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(QUERY_SAMPLE)
    taken = queries.join(F.broadcast(sample), "query_id")
    asked = folded.join(F.broadcast(taken), "h").select("query_id", "key", "v").toPandas()
    if not len(asked):
        return 0
    once = asked.drop_duplicates("key")
    shared = spark.sparkContext.broadcast((once["key"].to_numpy(), np.stack(once["v"].to_numpy())))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, vectors = shared.value
        search = _searched(dim, k + 1, 0)
        asks = pd.DataFrame({"keys": [keys.tobytes()], "queries": [vectors.tobytes()], "home": [0]})
        for frame in frames:
            yield search(frame.assign(number=0), asks)

    first = numbered.filter("curve = 0").select("ids", "counts", "vectors")
    answers = _best(first.mapInPandas(exact, "key long, vec_id long, score double"), k + 1, "key").toPandas()
    answers = asked[["query_id", "key"]].merge(answers, on="key")
    answers = answers[answers["query_id"] != answers["vec_id"]]
    # A repeated id with several vectors asks for the best of all of them.
    answers = answers.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    answers = answers.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)[["query_id", "key", "vec_id"]]
    wanted = spark.sparkContext.broadcast((np.unique(answers["vec_id"].to_numpy()), once["key"].to_numpy()))

    def located(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for curve, number, kind, column in [
                (c, n, q, x)
                for c, n, a, b in zip(frame["curve"], frame["number"], frame["ids"], frame["keys"])
                for q, x in ((False, a), (True, b))
            ]:
                here = np.frombuffer(column, np.int64)
                here = here[np.isin(here, wanted.value[kind])]
                yield pd.DataFrame({"curve": curve, "number": number, "query": kind, "id": here})

    places = numbered.select("curve", "number", "ids", "keys").mapInPandas(
        located, "curve int, number int, query boolean, id long"
    ).toPandas()
    own = places[places["query"]].rename(columns={"id": "key", "number": "home"})[["curve", "key", "home"]]
    other = places[~places["query"]].rename(columns={"id": "vec_id"})[["curve", "vec_id", "number"]]
    far = answers.merge(own, on="key").merge(other, on=["curve", "vec_id"])
    nearest = (far["home"] - far["number"]).abs().groupby([far["query_id"], far["vec_id"]]).min().sort_values()
    return int(nearest.iloc[min(len(nearest) - 1, int(np.ceil(WANTED * len(nearest))))]) if len(nearest) else 0


def nearest(
    rows: DataFrame,
    query_step: int = 20,
    k: int = NEIGHBOURS,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `query_step` divides.

    All other rows are candidates. Vectors that are null, zero, or hold null, NaN or infinite
    components take no part, nor do those of another length than most; a repeated id is
    searched and found once, by its best score. An empty table gives no rows.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    base = saved(usable(rows, id_col, vector_col), "vectors")
    lengths = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    folded, queries = _folded(base.filter(F.size("v") == dim), query_step, k)
    n = folded.count()
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(np.sqrt(folded.agg(F.max(norm)).first()[0]))
    sample = folded.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.lit(max(1, GRID_SAMPLE * (1 << 20) // n)))
    seen = np.array([r["v"] for r in sample.select("v").limit(2 * GRID_SAMPLE).collect()] or [[longest] + [0.0] * (dim - 1)])
    shared = spark.sparkContext.broadcast(Curves(seen, longest))
    kind = "curve int, place long, query boolean, key long, ids binary, v binary"
    placed = folded.select("key", "v", "ids", "n").mapInPandas(_placed(shared), kind)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), CURVES)
    # A query lies beside its own vector where both have one place.
    order = ["curve", "place", "key", "query"]
    ordered = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    blocks = saved(ordered.mapInPandas(_blocked(block), _BLOCK_TYPE), "blocks")
    # Tasks hold ranges in their order, so blocks do too.
    numbers = (
        blocks.select("curve", "block")
        .distinct()
        .select("curve", "block", (F.row_number().over(W.partitionBy("curve").orderBy("block")) - 1).alias("number"))
    )
    numbered = saved(blocks.join(numbers, ["curve", "block"]), "numbered")
    reach = _window(numbered, folded, queries, dim, k)
    stretch = lambda number: F.floor(number / TOGETHER)
    last = numbered.groupBy("curve").agg(F.max("number").alias("last"))
    asks = (
        numbered.filter(F.length("keys") > 0)
        .select("curve", "number", "keys", "queries")
        .join(F.broadcast(last), "curve")
        .select(
            F.col("curve").alias("line"),
            F.col("number").alias("home"),
            F.explode(
                F.sequence(
                    stretch(F.greatest(F.col("number") - reach, F.lit(0))),
                    stretch(F.least(F.col("number") + reach, F.col("last"))),
                )
            ).alias("target"),
            "keys",
            "queries",
        )
    )
    # Queries of a stretch are dealt to as many groups as keep them bounded, each with all blocks.
    parts = saved(
        asks.groupBy("line", "target").agg(F.ceil(F.sum(F.length("keys")) / (8 * ASKED)).alias("parts")), "parts"
    )
    asks = asks.join(F.broadcast(parts), ["line", "target"])
    asks = asks.withColumn("part", F.pmod(F.xxhash64("keys"), "parts")).drop("parts")
    dealt = parts.select(F.col("line").alias("curve"), F.col("target").alias("stretch"), F.col("parts").alias("groups"))
    found = (
        numbered.filter(F.length("ids") > 0)
        .select("curve", stretch(F.col("number")).alias("stretch"), "number", "ids", "counts", "vectors")
        .join(F.broadcast(dealt), ["curve", "stretch"])
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        .drop("groups")
        .groupBy("curve", "stretch", "part")
        .cogroup(asks.groupBy("line", "target", "part"))
        .applyInPandas(_searched(dim, k + 1, reach), "key long, vec_id long, score double")
    )
    near = _best(found, k + 1, "key").groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    answers = saved(folded.select("key", "h", "n").join(near, "key").select("h", "n", "near"), "answers")
    pairs = (
        join_hot(queries, answers, "h", "n", "inner")
        .select("query_id", F.inline("near"))
        .filter("query_id != vec_id")
    )
    return _best(pairs, k, "query_id").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
