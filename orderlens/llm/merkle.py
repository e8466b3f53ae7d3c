"""Merkle manifest of a table: only every second level is stored, proofs recompute the rest.

The rows of each tree are leaves in the order of an id; 16 consecutive nodes become their
parent until one is left. What is stored is a row for each aligned subtree of two levels (a
stretch of 256 nodes), for every second level up. A proof is put together from the stretches
above a leaf: the level in between is computed anew from the stretch's own nodes, gives its
siblings and is dropped with the row. The trees' roots are the leaves of one more tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.llm.common import saved

FANOUT = 16
# Levels of a stored subtree, and the nodes at its foot.
STEP = 2
SPAN = FANOUT**STEP

# Bits of monotonically_increasing_id that count the rows of one partition.
_PLACE_BITS = 33
_STEP_TYPE = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Manifest:
    """Stored levels of all trees and of the tree over their roots, from the foot up.

    Each level has one row per stretch: tree, nodes (how many the tree has at this level),
    block (the stretch's number) and run, its items in order. An item has its node, at the
    foot of the trees also id and claim.
    """

    trees: list[DataFrame]
    top: list[DataFrame]


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def build(
    docs: DataFrame, columns: list[str], tree_col: str, id_col: str, claim: Column | None = None
) -> Manifest:
    """The manifest of a table: a leaf per row over `columns`, a tree per value of `tree_col`.

    Leaves ascend by id, null ids first; of one id they ascend by their digest. Null is a tree
    of its own, before the others. `claim` is a digest that is to be held against the root in
    the leaf's place (null: the leaf itself). An empty table has a manifest without rows.
    """
    values = [F.col(f"`{name}`") for name in columns]
    source = F.col(f"`{tree_col}`").cast("string")
    leaves = saved(
        docs.select(
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"),
            F.col(f"`{id_col}`").alias("id"),
            leaf(values).alias("node"),
            (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "leaves",
    )
    order = [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")]
    trees = _levels(_numbered(leaves, order, F.struct("node", "id", "claim")))
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("run")[0]["node"].alias("node"))
    top = _levels(_numbered(roots, [F.col("of")], F.struct("node", "of")))
    return Manifest(trees, top)


def _numbered(rows: DataFrame, order: list[Column], item: Column) -> DataFrame:
    """(tree, at, nodes, item): place within the tree and the tree's size.

    Rows are dealt by ranges of (tree, order), so that a large tree takes many tasks. A place
    is what a row has within its range, moved by what earlier ranges hold of the tree.
    """
    ordered = saved(
        rows.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .select("tree", item.alias("item"), F.monotonically_increasing_id().alias("place")),
        "ordered",
    )
    part = F.shiftright("place", _PLACE_BITS).alias("part")
    ranges = ordered.groupBy("tree", part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moves = ranges.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("move"),
        F.sum("n").over(tree).alias("nodes"),
    )
    return ordered.withColumn("part", part).join(moves, ["tree", "part"]).select(
        "tree", (F.col("place") + F.col("move")).alias("at"), "nodes", "item"
    )


def _levels(numbered: DataFrame) -> list[DataFrame]:
    levels = [_stretches(numbered)]
    while not levels[-1].filter("nodes > 1").isEmpty():
        climbed = _regenerated(levels[-1])
        last = F.col(f"level{STEP}")
        above = climbed.select(
            "tree",
            F.col("block").alias("at"),
            F.expr(f"(nodes + {SPAN - 1}) div {SPAN}").alias("nodes"),
            F.struct(last[0].alias("node")).alias("item"),
        )
        levels.append(_stretches(above))
    return levels


def _stretches(numbered: DataFrame) -> DataFrame:
    grouped = numbered.groupBy("tree", "nodes", F.expr(f"at div {SPAN}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "item"))).alias("run")
    )
    return saved(grouped.withColumn("run", F.expr("transform(run, x -> x.item)")), "stretches")


def _regenerated(stretches: DataFrame) -> DataFrame:
    """A stretch's levels as `level0`, `level1`, ... A level that the tree lacks is as the one below."""
    out = stretches.withColumn("level0", F.expr("transform(run, x -> x.node)"))
    for i in range(STEP):
        parents = (
            f"transform(sequence(0, (size(level{i}) - 1) div {FANOUT}), i -> "
            f"sha2(array_join(slice(level{i}, i * {FANOUT} + 1, {FANOUT}), ''), 256))"
        )
        out = out.withColumn(
            f"level{i + 1}", F.expr(f"CASE WHEN nodes > {FANOUT**i} THEN {parents} ELSE level{i} END")
        )
    return out


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, item, path) for each item at the foot; `above` is (tree, path) of the roots.

    From the top down: a stretch's node is an item of the stretch above, whose path it shares.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("at"), "path")
    for stretches in reversed(levels):
        met = _regenerated(stretches).join(
            known.withColumnRenamed("at", "block"), ["tree", "block"]
        )
        each = met.select(
            "tree", "nodes", "block", "path", "run", *[f"level{i}" for i in range(STEP)], F.expr("size(run)").alias("n")
        ).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        own = ", ".join(_siblings(level) for level in range(STEP))
        found = each.select(
            "tree",
            F.expr(f"block * {SPAN} + i").alias("at"),
            F.expr("run[i]").alias("item"),
            F.expr(f"concat(filter(array({own}), x -> x IS NOT NULL), path)").alias("path"),
        )
        known = saved(found.select("tree", "at", "path"), "paths") if stretches is not levels[0] else found
    return known.select("tree", "item", "path")


def _siblings(level: int) -> str:
    """The other nodes of an item's run at a level of its stretch, null where the tree is lower."""
    place = f"(i div {FANOUT**level})"
    base = f"({place} div {FANOUT} * {FANOUT})"
    return (
        f"CASE WHEN nodes > {FANOUT**level} THEN named_struct("
        f"'left', array_join(slice(level{level}, {base} + 1, {place} - {base}), ''), "
        f"'right', array_join(slice(level{level}, {place} + 2, {base} + {FANOUT - 1} - {place}), '')) END"
    )


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, leaf, claim, subroot, root and path.

    The path has one entry per level up to the root, with the siblings to the left and to the
    right of the leaf's ancestor as text; `fold` computes the root from it.
    """
    start = manifest.top[-1].select("tree", F.expr(f"CAST(array() AS {_STEP_TYPE})").alias("path"))
    root = manifest.top[-1].select("tree", F.col("run")[0]["node"].alias("root"))
    tops = _paths(manifest.top, start).join(root, "tree").select(
        F.col("item.of").alias("tree"), F.col("item.node").alias("subroot"), "root", "path"
    )
    tops = saved(tops, "tops")
    found = _paths(manifest.trees, tops.select("tree", "path"))
    return found.join(tops.select("tree", "subroot", "root"), "tree").select(
        F.col("item.id").alias("id"),
        F.col("item.node").alias("leaf"),
        F.col("item.claim").alias("claim"),
        "subroot",
        "root",
        "path",
    )


def siblings(path: Column) -> Column:
    """All digests of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(
        path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256)
    )
