import itertools

import numpy as np

from orderlens.llm import neighbours
from orderlens.llm.queries import QUERIES


def exact(ids, vectors, query, k):
    scores = vectors @ vectors[ids.tolist().index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))
    return [(int(ids[i]), scores[i]) for i in order[:k]]


def test_query_recall(spark, sf_dir):
    rows = QUERIES["op9_nearest_neighbours"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found, hits = {}, 0
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for query, own in found.items():
        assert [r.rank for r in own] == list(range(1, min(20, len(ids) - 1) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            pair = vectors[ids == query][0] @ vectors[ids == r.vec_id][0]
            assert abs(r.score - pair) < 1e-12
        hits += len({r.vec_id for r in own} & {i for i, _ in exact(ids, vectors, query, 20)})
    assert hits >= 0.9 * len(rows)


def test_hilbert_steps_are_neighbours():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        places = neighbours.hilbert(cells, bits)
        assert sorted(places.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(places)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_several_blocks_and_lengths(spark):
    """Clustered vectors of different lengths; windows smaller than the table."""
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 12)) * 4
    vectors = np.concatenate([c + draw.standard_normal((50, 12)) * 0.5 for c in centres])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(rows, block=64).collect()
    ids, hits = np.arange(len(vectors)), 0
    for query in range(0, len(vectors), 20):
        hits += len({r.vec_id for r in found if r.query_id == query} & {i for i, _ in exact(ids, vectors, query, 20)})
    assert hits >= 0.9 * 20 * 100


def test_odd_vectors(spark):
    good = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    values = [(i * 20, v, "x") for i, v in enumerate(good + bad)] + [(None, [1.0, 0.0], "x")]
    rows = spark.createDataFrame(values, "vec_id long, embedding array<float>, place string")
    found = neighbours.nearest(rows).collect()
    assert {r.query_id for r in found} == {0, 20, 40, 60, 80}
    first = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == 0)
    assert first == [(1, 40, 1.0), (2, 60, 1.0), (3, 20, 0.0), (4, 80, -1.0)]
    assert neighbours.nearest(rows.limit(0)).collect() == []


def test_many_equal_vectors(spark):
    rows = spark.range(3000).selectExpr("id as vec_id", "array(0.6D, 0.8D, cast(id % 3 = 1 as double)) as embedding")
    found = neighbours.nearest(rows, block=128).filter("query_id = 60").orderBy("rank").collect()
    same = [i for i in range(3000) if (i % 3 == 1) == (60 % 3 == 1) and i != 60]
    assert len(found) == 20 and all(abs(r.score - 1.0) < 1e-12 for r in found)
    assert {r.vec_id for r in found} <= set(range(3000)) - {60} and same


def test_equal_vectors_among_many_blocks(spark):
    """Half of all vectors are one, the rest lie in clusters: its queries have its smallest ids, exactly."""
    draw = np.random.default_rng(5)
    vectors = np.repeat(draw.standard_normal((60, 6)), 50, axis=0) + draw.standard_normal((3000, 6)) * 0.02
    vectors = np.concatenate([vectors, np.repeat(draw.standard_normal((1, 6)), 3000, axis=0)])
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    ids = draw.permutation(len(vectors))
    same, hits, found = np.sort(ids[3000:]).tolist(), 0, {}
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(rows, block=8).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == set(range(0, len(ids), 20))
    for query, own in found.items():
        got = [i for _, i in sorted(own)]
        if query in same:
            assert got == [i for i in same if i != query][:20]
        hits += len(set(got) & {i for i, _ in exact(ids, vectors, query, 20)})
    assert hits >= 0.9 * 20 * len(found)


def test_repeated_ids(spark):
    """Every row twice, and each tenth id with a second and a third vector of its own."""
    draw = np.random.default_rng(6)
    vectors = draw.standard_normal((400, 5))
    pairs = [(i, v) for i, v in enumerate(vectors)] * 2
    pairs += [(i, vectors[i] * s) for i in range(0, 400, 10) for s in (1.5, 2.0)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in pairs], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(rows, block=1024).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 20))
    hits = 0
    for query, own in found.items():
        best = {}
        for i, v in pairs:
            for q in (vectors[query] * s for s in (1, 1.5, 2)):
                best[i] = max(best.get(i, -np.inf), q @ v)
        wanted = sorted((-s, i) for i, s in best.items() if i != query)[:20]
        assert len({i for _, i, _ in own}) == len(own) == 20
        hits += sum(abs(best[i] - s) < 1e-9 for _, i, s in own if i in {i for _, i in wanted})
    assert hits >= 0.9 * 20 * len(found)


def test_repeated_ids_in_a_block():
    vectors = np.array([[5.0], [4.0], [3.0], [2.0], [1.0]])
    ids, counts = np.array([7, 7, 7, 8, 9, 10]), np.array([1, 1, 1, 2, 1])
    found = neighbours.ranked(np.array([[1.0]]), np.array([3]), vectors, ids, counts, 3)
    assert [c.tolist() for c in found] == [[3, 3, 3], [7, 8, 9], [5.0, 2.0, 2.0]]


def test_blocks_hold_bounded_queries(spark):
    """Many queries between two vectors: several rows of one block, no cell of all of them."""
    asked = [i >= 20 and i < 520 for i in range(540)]
    rows = [(0, i, q, i, b"" if q else i.to_bytes(8, "little"), bytes(16)) for i, q in enumerate(asked)]
    kind = "curve int, place long, query boolean, key long, ids binary, v binary"
    placed = spark.createDataFrame(rows, kind).coalesce(1).sortWithinPartitions("place")
    blocks = placed.mapInPandas(neighbours._blocked(16), neighbours._BLOCK_TYPE).collect()
    assert max(len(b.keys) for b in blocks) <= 16 * 8 and max(len(b.vectors) for b in blocks) <= 16 * 16
    keys = np.frombuffer(b"".join(b.keys for b in blocks), np.int64)
    assert keys.tolist() == list(range(20, 520))
    # All 500 have the block of the vectors 16 to 19, whose other vectors come after them.
    assert len({b.block for b in blocks if len(b.keys)}) == 1
    sizes = {}
    for b in blocks:
        sizes[b.block] = sizes.get(b.block, 0) + len(b.ids) // 8
    assert sorted(sizes.values()) == [8, 16, 16]


def test_many_queries_of_one_direction(spark, monkeypatch):
    """All queries fall to one place; they are dealt to groups and searched in slices."""
    monkeypatch.setattr(neighbours, "ASKED", 8)
    rows = spark.range(1200).selectExpr("id as vec_id", "array(0.6D * (id + 1), 0.8D * (id + 1)) as embedding")
    found = {}
    for r in neighbours.nearest(rows, block=32, k=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == set(range(0, 1200, 20))
    hits = sum(len({i for _, i in own} & {i for i in range(1194, 1200) if i != q}) for q, own in found.items())
    assert hits >= 0.9 * 5 * len(found)
