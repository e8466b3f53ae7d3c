import itertools

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from orderlens.llm import jaccard
from orderlens.llm.oracles import ORACLES
from orderlens.llm.queries import QUERIES


def shingles(text, words=4):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain(rows, percent=85):
    """(doc_id, n_shingles, component_id) of all rows, from all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[top(a)] = top(b)
    least = {}
    for i, (doc_id, held) in enumerate(sets):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i))) for i, (d, s) in enumerate(sets)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def families(seed, n_families, sizes, copies):
    """Texts with copies in which a few words are changed, dropped, added or moved."""
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(0, 400)}"
    texts = []
    for _ in range(n_families):
        base = [word() for _ in range(draw.integers(*sizes))]
        texts.append(" ".join(base))
        for _ in range(draw.integers(0, copies)):
            other = list(base)
            for _ in range(draw.integers(0, 1 + len(base) // 25)):
                at = draw.integers(0, len(other))
                other[at : at + draw.integers(0, 2)] = [word()] * draw.integers(0, 2)
            texts.append("  ".join(other).upper() if draw.random() < 0.3 else "\n".join(other))
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_query_against_sql_and_plain(spark, sf_dir):
    df = QUERIES["op13_jaccard_join"](spark, sf_dir)
    assert difference(df, connect(sf_dir), ORACLES["op13_jaccard_join"]) is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = got(df)
    assert rows == plain([tuple(r) for r in docs])
    assert len({r[2] for r in rows}) < len(rows)


@pytest.mark.parametrize("light", [None, jaccard.MOST_LIGHT])
def test_families_with_any_boundary(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "HUBS", (1, 2, 3))
    monkeypatch.setattr(jaccard, "SHORT", 3)
    rows = families(1, 25, (1, 30), 8) + [(1000 + i, t) for i, t in families(2, 6, (60, 200), 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.jaccard_components(docs, light=light)) == plain(rows)


def test_boundary_is_where_subsets_and_lists_cost_least(spark):
    size = "id % 20 + 10"
    classes = spark.range(400).selectExpr("id AS class", f"{size} AS n", "array(1L) AS first")
    lists = classes.selectExpr("n", "CASE WHEN n < 20 THEN 100L ELSE 1L END AS size")
    # Sets of 10 to 13 elements have 3 subsets of 3 elements, those of 14 to 19 six of four.
    assert jaccard.boundary(classes, lists) >= 19
    assert jaccard.boundary(classes, lists.selectExpr("n", "1L AS size")) == 0


def test_lists_without_a_centre_go_on_to_the_last_member(spark, monkeypatch):
    """A chain: each text links to the next alone, so no hub joins the list at once."""
    monkeypatch.setattr(jaccard, "HUBS", (1,))
    monkeypatch.setattr(jaccard, "SHORT", 1)
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 80])) for i in range(10)]
    rows += [(50 + i, " ".join(words[20 * i : 20 * i + 80])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain(rows)
    assert {r[2] for r in wanted if r[0] < 50} == {0}
    assert got(jaccard.jaccard_components(docs)) == wanted


def test_one_large_group_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 :]])) for i in range(200)]
    rows += [(600 + i, f"a text of its own with number {i} and words v{i} u{i} t{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = jaccard.jaccard_components(docs)
    assert got(found) == plain(rows)
    assert found.filter("class_size = 300").count() == 300


def test_bounds_of_similarity():
    for n in range(1, 400):
        p = jaccard.reach(n, 85)
        for m in range(n, 500):
            shared = next(k for k in range(n + m) if 100 * k >= 85 * (n + m - k))
            if shared > n or (m == n and shared == n):
                continue
            # Two sets that share so many cannot avoid each other in their first elements.
            assert jaccard.can_link(n, 85) and n - shared + 2 <= p + 1 and m - shared + 2 <= jaccard.reach(m, 85) + 1


def test_signatures_never_exceed_the_difference():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b, c = (draw.integers(0, 2**63, draw.integers(1, 900)).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([a, c])), np.unique(np.concatenate([b, c]))
        p, q = sorted((jaccard.signature(x), jaccard.signature(y)), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        differ = np.bitwise_count((p ^ q).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(x, y))


def test_odd_rows(spark, odd):
    docs = odd.select(*odd.columns, F.lit(1).alias("class"), F.lit(2).alias("n"), F.lit(3).alias("first"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard.jaccard_components(docs)) == plain(rows)


def test_empty_table(spark, nothing):
    assert jaccard.jaccard_components(nothing).collect() == []


def test_a_very_long_text(spark):
    draw = np.random.default_rng(6)
    words = [f"w{i}" for i in draw.integers(0, 50_000, 1_500_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[10_000:])), (3, " ".join(words[: len(words) // 2])), (4, "short")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def written(monkeypatch):
    """The tables that are saved from now on, as (label, frame)."""
    tables, save = [], jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, label: (tables.append((label, save(df, label))), tables[-1][1])[1])
    return tables


def test_sets_that_share_too_little_are_on_no_list(spark, monkeypatch):
    """Each text shares four words with another one and has nothing else in common with any."""
    # As on much data, where the counters no longer tell which elements are rare.
    monkeypatch.setattr(jaccard, "commonness", lambda texts, words: np.zeros(jaccard.COUNTERS, np.uint8))
    rows = []
    for i in range(400):
        own = [f"w{i}x{j}" for j in range(40)]
        own[20:24] = [f"p{i // 2}y{j}" for j in range(4)]
        rows.append((i, " ".join(own)))
    tables = written(monkeypatch)
    found = got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == plain(rows)
    assert [df.count() for label, df in tables if label == "lists"] == [0]


def test_near_copies_that_do_not_link_are_compared_in_few_rounds(spark, monkeypatch):
    draw = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(110)], []
    for i in range(420):
        words = list(base)
        for at in draw.integers(0, len(base), 3):
            words.insert(at, f"x{i}y{at}")
        rows.append((i, " ".join(words)))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join([*words, "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tables = written(monkeypatch)
    found = got(jaccard.jaccard_components(docs, light=0))
    assert found == plain(rows)
    assert 300 < len({r[2] for r in found}) < len(rows)
    first = next(df for label, df in tables if label == "members")
    assert first.groupBy("key").count().agg(F.max("count")).first()[0] > 400
    assert sum(label == "pairs" for label, _ in tables) <= 3
    # A pair is named by one of its lists, not by each, and so are all of the pairs a bounded number.
    assert sum(df.count() for label, df in tables if label == "named" and "next" in df.columns) < 3 * len(rows)


def test_shared_elements_in_sql_and_plain(spark):
    for percent in (51, 70, 85, 99):
        sizes = [n for n in range(1, 3000) if jaccard.can_link(n, percent)]
        asked = [jaccard.in_common(n, percent) for n in sizes]
        assert asked == sorted(asked)
        assert all(2 <= k <= jaccard.least_overlap(n, percent) for n, k in zip(sizes, asked))
        rows = spark.createDataFrame([(n,) for n in sizes], "n long").selectExpr("n", jaccard._in_common("n", percent)).collect()
        assert {r[0]: r[1] for r in rows} == dict(zip(sizes, asked))


def test_rows_whose_key_another_row_has():
    import pyarrow as pa

    key = np.repeat([3, 4, 7, 8, 9], [1, 2, 1, 5, 1])
    for step in range(1, 11):
        parts = [slice(i, i + step) for i in range(0, 10, step)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c[p]) for c in (key, np.arange(10), np.arange(10, dtype=np.int32))], names=["key", "class", "pos"]) for p in parts)
        out = [x for b in jaccard._several(batches) for x in zip(b["key"].to_pylist(), b["class"].to_pylist())]
        assert out == [(4, 1), (4, 2), (8, 4), (8, 5), (8, 6), (8, 7), (8, 8)]
