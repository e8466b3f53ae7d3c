"""The short forms of a fold against the fold."""

from pyspark.sql import functions as F

from orderlens.operators.changes import fold, fold_pairs, last_rows

SCHEMA = "k string, a string, b int, present array<string>, seq int"


def canonical(df):
    return sorted((r["k"], r["a"], r["b"], tuple(r["present"])) for r in df.collect())


def test_last_rows_are_folded_rows(spark):
    every = ["k", "a", "b"]
    rows = [(f"k{n % 5}", None if n % 3 == 0 else f"a{n}", n if n % 2 else None, every, n) for n in range(40)]
    changes = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert canonical(last_rows(changes, "k", "seq")) == canonical(fold(changes, "k", "seq"))


def test_pairs_are_folded_as_all_their_fields(spark):
    every, rows = ["k", "a", "b"], []
    sets = [every, ["k"], ["k", "a"], ["k", "b"], ["k", "b", "a"], None]
    for i, old in enumerate(sets):
        for j, new in enumerate(sets):
            if old:
                rows.append((f"{i}{j}", "old" if "a" in old else None, 1 if "b" in old else None, old, 0))
            if new:
                value = None if i % 2 else "new"
                rows.append((f"{i}{j}", value if "a" in new else None, 2 if "b" in new else None, new, 1))
    changes = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.hash("k") % 3)
    pairs = fold_pairs(changes, "k", "seq", within=("part",))
    assert canonical(pairs) == canonical(fold(changes, "k", "seq", within=("part",)))
    assert len(canonical(pairs)) == 35
