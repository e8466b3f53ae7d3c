"""Field-wise upserts.

A change sets the fields it holds and leaves the others. It is kept as a row with the names
of the fields it sets in `present`; the value in force is, per key and field, that of the
latest change which set the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRESENT = "present"


def fold(changes: DataFrame, key: str, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One change per key with the same effect as all its changes in the order of a column.

    `within` names columns that follow from the key, such as its bucket, and are kept: rows
    that are already dealt by them are not shuffled again.

    `max_by` folds within each task before the shuffle, so a key with very many changes
    sends one row per task. It skips rows whose ordering is null: here, the changes that do
    not set the field.
    """
    fields = [name for name in changes.columns if name not in (key, PRESENT, order, *within)]
    is_set = {name: f"array_contains({PRESENT}, '{name}')" for name in (key, *fields)}
    latest = [f"max_by(`{n}`, CASE WHEN {is_set[n]} THEN `{order}` END) AS `{n}`" for n in fields]
    flags = [f"CASE WHEN bool_or({test}) THEN '{name}' END" for name, test in is_set.items()]
    present = f"array_compact(array({', '.join(flags)})) AS {PRESENT}"
    return changes.groupBy(*within, key).agg(*[F.expr(text) for text in (*latest, present)])


def last_rows(changes: DataFrame, key: str, order: str) -> DataFrame:
    """`fold` of changes that all set all fields: of each key the last row, as it is.

    The order is compared once for a row, not for each of its fields.
    """
    fields = [name for name in changes.columns if name not in (key, PRESENT, order)]
    last = F.max_by(F.struct(*fields), F.col(order)).alias("_last")
    every = F.array(*[F.lit(name) for name in (key, *fields)]).alias(PRESENT)
    return changes.groupBy(key).agg(last).select(key, *[f"_last.{name}" for name in fields], every)


def fold_pairs(rows: DataFrame, key: str, order: str, within: tuple[str, ...]) -> DataFrame:
    """`fold` of two rows at most of a key, the row in force and its change.

    Rows that are already dealt by the columns of `within` are not shuffled again.
    """
    fields = [name for name in rows.columns if name not in (key, PRESENT, order, *within)]
    row = F.struct(*fields, PRESENT)
    pairs = rows.groupBy(*within, key).agg(
        F.max_by(row, F.col(order)).alias("_new"), F.min_by(row, F.col(order)).alias("_old")
    )

    def sets(side: str, name: str) -> Column:
        return F.array_contains(f"{side}.{PRESENT}", name)

    values = {n: F.when(sets("_new", n), F.col(f"_new.{n}")).otherwise(F.col(f"_old.{n}")) for n in fields}
    every, new, old = F.array(*[F.lit(n) for n in (key, *fields)]), F.col(f"_new.{PRESENT}"), F.col(f"_old.{PRESENT}")
    either = F.when((new == every) | (old == every), every).otherwise(F.array_intersect(every, F.concat(new, old)))
    return pairs.select(*within, key, *[value.alias(n) for n, value in values.items()], either.alias(PRESENT))


def merge(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Folded `changes` over folded `state`, both one row per key.

    A row of the state that no change names is passed on as it is: the changes are the
    small side, so the state is not shuffled. Only rows that meet are folded again.
    """
    old, new = state.alias("old"), changes.select(key).alias("new")
    same = F.expr(f"old.`{key}` <=> new.`{key}`")
    untouched = old.join(new, same, "left_anti")
    touched = old.join(new, same, "left_semi").withColumn("_age", F.lit(0))
    both = touched.unionByName(changes.withColumn("_age", F.lit(1)))
    return untouched.unionByName(fold(both, key, "_age"))
