"""Recurring lines by a tree of log templates, with DataFrame functions only.

A line is parsed at fixed depth: its number of tokens, then its leading tokens, in which
every token with a digit counts as variable. A leaf has as many templates as it needs: the more
frequent forms come first, lines that agree with one in most tokens belong to it, and the
tokens in which they differ are variable too. Templates that recur across documents are dropped, except in the
first document that has them. A line of variable tokens alone, as a number, has nothing that
names its kind: it counts by its exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import documents, join_hot, saved
from orderlens.session import work_dir

VARIABLE = "<*>"
# Depth of the tree below the number of tokens, and the share of equal tokens.
LEADING = 4
SIMILAR = 0.8
# Documents from which on a template recurs.
LEAST_DOCS = 2
# Buckets that are broadcast whole.
FEW = 20_000
_MOVED = "form long, head long, lines long"

# White space other than one blank; a whole token with a digit, tried at its start only.
_NOT_ONE_BLANK = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*"
_TOKEN = r"[^\x20\x09-\x0D]"
_ALL_VARIABLE = r"^<\*>(?: <\*>)*$"


def plain(line: Column) -> Column:
    """The line in single blanks. Most lines have nothing to replace, which a search finds sooner."""
    odd = line.contains("  ") | line.rlike(r"[\x09-\x0D]")
    return F.trim(F.when(odd, F.regexp_replace(line, _NOT_ONE_BLANK, " ")).otherwise(line))


def form(plain: Column) -> Column:
    """A plain line, tokens with a digit as variable."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _WITH_DIGIT, VARIABLE)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, leaf, key, form): every line that has a token."""
    size = F.length("form") - F.length(F.replace(F.col("form"), F.lit(" "))) + 1
    leaf = F.xxhash64(size, F.substring_index("form", " ", LEADING))
    return (
        # Hashed before the lines part, and tested as they are: Spark would work out the form once
        # more for a test of it.
        docs.withColumn("text_hash", F.xxhash64("text"))
        .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
        .filter(F.col("value").rlike(_TOKEN))
        .select("doc_id", "text_hash", "line", plain(F.col("value")).alias("plain"))
        .select("*", form(F.col("plain")).alias("form"))
        .withColumn("bare", F.col("form").startswith(VARIABLE) & F.col("form").rlike(_ALL_VARIABLE))
        # A bare line is alone in its leaf.
        .withColumn("form", F.when(F.col("bare"), F.col("plain")).otherwise(F.col("form")))
        .select(
            "doc_id",
            "text_hash",
            "line",
            F.when(F.col("bare"), F.xxhash64(F.col("form"), F.lit(VARIABLE))).otherwise(leaf).alias("leaf"),
            F.xxhash64("form").alias("key"),
            "form",
        )
    )


def _buckets(tokens: Column, leaf: Column) -> Column:
    """One number for each part of the tokens; two forms of a leaf that agree have one in common.

    There is one part more than tokens in which such forms may differ, so one part is equal.
    `tokens` must be a column: an expression would be worked out anew for each part.
    """
    size = F.size(tokens)
    parts = size - F.ceil(SIMILAR * size) + 1
    rest = F.greatest(size - LEADING, F.lit(0))
    start = lambda i: F.floor(i * rest / parts).cast("int")
    part = lambda i: F.array_join(F.slice(tokens, start(i) + LEADING + 1, start(i + 1) - start(i)), " ")
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.xxhash64(leaf, i, part(i)))


def _moved(forms: DataFrame) -> DataFrame:
    """(form, head, lines) of the forms that belong to another, by hashes, from (leaf, form, lines).

    In each round a form that comes first in all of its buckets is a template, and all forms
    that agree with it join it; they meet it in a bucket, so what is left agrees with no
    template yet. Forms that meet no other are done. Equally frequent forms come by hash.
    """
    spark = forms.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = saved(forms.repartition(wide, "leaf", "form").select(F.xxhash64("form").alias("key"), "leaf", "form", "lines"), "texts")
    split = texts.select("key", "lines", "leaf", F.split("form", " ").alias("tokens"))
    left = saved(split.select("key", "lines", F.explode(_buckets(F.col("tokens"), F.col("leaf"))).alias("bucket")), "left")
    moved, rounds = work_dir(spark, "moved"), 0
    while True:
        first = F.min(F.struct(-F.col("lines"), "key")).alias("top")
        tops = saved(left.groupBy("bucket").agg(first, F.count("*").alias("n")).filter("n > 1"), "tops")
        shared = tops.count()
        if not shared:
            break
        # What meets no other form is done and leaves here. Few buckets, of four numbers each, are
        # broadcast whole, more of them by their size.
        if shared <= FEW:
            met = left.join(F.broadcast(tops.select("bucket", "top")), "bucket")
        else:
            met = join_hot(left, tops, "bucket", "n", "inner").select("bucket", "key", "lines", "top")
        # Laid anew, so that the rounds' files get fewer as their rows do.
        met = saved(met.repartition("key"), "met")
        best = met.groupBy("key").agg(F.min("top")["key"].alias("top"))
        texts = saved(texts.join(best, "key").select("key", "form", "lines", (F.col("key") == F.col("top")).alias("heads")), "texts")
        heads = texts.filter("heads").select(F.col("key").alias("head"), F.col("form").alias("text"), F.col("lines").alias("of"))
        pairs = met.select("key", F.col("top")["key"].alias("head")).filter("key != head").distinct()
        pairs = saved(pairs.join(heads.select("head"), "head"), "pairs")
        # How many forms meet a template, so that a frequent one comes by broadcast.
        named = saved(heads.join(pairs.groupBy("head").agg(F.count("*").alias("n")), "head"), "named")
        near = join_hot(pairs.join(texts.select("key", "form", "lines"), "key"), named, "head", "n", "inner")
        own, other = F.split("form", " "), F.split("text", " ")
        equal = F.size(F.filter(F.zip_with(own, other, lambda a, b: a == b), lambda x: x))
        (
            near.filter(equal >= SIMILAR * F.size(own))
            .groupBy("key", "lines")
            .agg(F.min(F.struct(-F.col("of"), "head"))["head"].alias("head"))
            .select(F.col("key").alias("form"), "head", "lines")
            .write.parquet(f"{moved}/round={rounds}")
        )
        joined = spark.read.schema(_MOVED).parquet(f"{moved}/round={rounds}")
        placed = heads.select(F.col("head").alias("key")).unionByName(joined.select(F.col("form").alias("key")))
        left = saved(met.select("bucket", "key", "lines").join(placed, "key", "left_anti"), "left")
        rounds += 1
    if not rounds:
        return spark.createDataFrame([], _MOVED)
    return spark.read.schema(_MOVED).parquet(*[f"{moved}/round={i}" for i in range(rounds)])


def dropped_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, line) of each line to drop, from (doc_id, text)."""
    texts = saved(_lines(docs), "lines")
    keys = texts.select("doc_id", "text_hash", "line", "leaf", F.col("key").alias("form"))
    # Only leaves with several forms have something to generalise and need the texts.
    several = saved(
        keys.groupBy("leaf")
        .agg(F.min("form").alias("a"), F.max("form").alias("b"), F.count("*").alias("n"))
        .filter("a != b")
        .select("leaf", "n"),
        "leaves",
    )
    forms = saved(
        join_hot(texts.select("leaf", "form"), several, "leaf", "n", "inner", "shuffle_hash")
        .groupBy("leaf", "form")
        .agg(F.count("*").alias("lines")),
        "forms",
    )
    moved = _moved(forms)
    placed = saved(
        join_hot(keys.select("doc_id", "text_hash", "line", "form"), moved, "form", "lines").select(
            "doc_id", "text_hash", "line", F.coalesce("head", "form").alias("template")
        ),
        "placed",
    )
    recurring = saved(
        placed.select("template", "doc_id")
        .distinct()
        .groupBy("template")
        .agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("docs") >= least_docs),
        "recurring",
    )
    return (
        join_hot(placed, recurring, "template", "docs", "inner")
        .filter(F.coalesce(F.col("doc_id") != F.col("first_doc"), F.lit(True)))
        .select("doc_id", "text_hash", "line")
        .distinct()
    )


def drop_recurring_lines(
    docs: DataFrame, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what is left of it).

    Lines end at line feeds; lines without a token are never dropped. Null and empty texts
    are one empty line. Repeated rows come out each and count as one document; a null id
    counts as none. An empty table gives no rows.
    """
    texts = documents(docs, id_col, text_col)
    gone = dropped_lines(texts, least_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))
    rows = texts.withColumn("text_hash", F.xxhash64("text")).alias("d")
    joined = rows.join(
        gone.alias("g"),
        F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash")),
        "left",
    ).select("d.doc_id", "text", "gone")
    lines = F.split("text", "\n", -1)
    place = F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True)))
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.try_element_at(place, i), F.lit(False)))
    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
