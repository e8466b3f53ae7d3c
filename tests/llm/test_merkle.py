import hashlib
import zlib

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from orderlens.llm import merkle
from orderlens.llm.oracles import ORACLES
from orderlens.llm.queries import QUERIES

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    held = [None if v is None else str(v) for v in values]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in held))


def climb(nodes):
    """The levels of a tree, from the leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def steps(levels, at):
    found = []
    for level in levels[:-1]:
        base = at // 16 * 16
        run = level[base : base + 16]
        found.append(("".join(run[: at - base]), "".join(run[at - base + 1 :])))
        at //= 16
    return found


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = climb([below[s][-1][0] for s in order])
    out = []
    for i, source in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(trees[source], key=lambda x: x[:3])):
            path = steps(below[source], at) + steps(top, i)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = plain_leaf([*row[:4], row[4].translate(LOWER)])
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(left + right for left, right in path))
            out.append((row[0], leaf, below[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(monkeypatch, spark, docs):
    monkeypatch.setattr("orderlens.llm.queries.documents", lambda *_: docs)
    return sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, "").collect()), key=repr)


def test_query_against_sql_and_plain(spark, sf_dir):
    df = QUERIES["op11_merkle_manifest"](spark, sf_dir)
    assert difference(df, connect(sf_dir), ORACLES["op11_merkle_manifest"]) is None
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*NAMES).collect()]
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows == plain(docs)
    assert {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 256), (257, 2, 4097)])
def test_trees_of_several_heights(spark, monkeypatch, sizes):
    rows = [
        (1000 * n + i, None if not n else f"é{n}", "en", i, f"Text {i} Of {n}")
        for n, size in enumerate(sizes)
        for i in range(size)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(monkeypatch, spark, docs.repartition(7)) == plain(rows)


def test_many_trees(spark, monkeypatch):
    rows = [(i, f"s{i % 300}", None, None, None if i % 7 == 0 else f"Doc {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(monkeypatch, spark, docs) == plain(rows)


def test_odd_rows(spark, monkeypatch, odd):
    docs = odd.select(*odd.columns, F.lit(1).alias("node"), F.lit(2).alias("tree"), F.lit(3).alias("claim"))
    rows = [tuple(r) for r in docs.select(*NAMES).collect()]
    assert found(monkeypatch, spark, docs) == plain(rows)


def test_empty_table(spark, monkeypatch, nothing):
    assert found(monkeypatch, spark, nothing) == []


def test_every_second_level_is_stored(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a' AS source", "CAST(id AS string) AS text")
    manifest = merkle.build(docs, ["doc_id", "text"], "source", "doc_id")
    # 5000 leaves have levels of 5000, 313, 20, 2 and 1 nodes: 313 and 2 are not stored.
    stored = [level.selectExpr("sum(size(run))").first()[0] for level in manifest.trees]
    assert stored == [5000, 20, 1]
    kept = merkle.proofs(manifest).select(F.size("path").alias("n")).distinct().collect()
    assert [r.n for r in kept] == [4]


def test_a_changed_row_fails_alone(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "'a' AS source", "CAST(id AS string) AS text")
    forged = F.when(F.col("doc_id") == 77, merkle.leaf([F.col("doc_id"), F.lit("other")]))
    rows = merkle.proofs(merkle.build(docs, ["doc_id", "text"], "source", "doc_id", forged))
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("path"))
    assert [r.id for r in rows.filter(folded != F.col("root")).collect()] == [77]
