"""Secrets by multipart linking, with DataFrame functions only.

Three kinds of match are reported wherever they occur. Three weaker kinds, which alone say
little, are reported only when a part of another role lies near: an identifier, a secret and
an endpoint complement each other. "Near" is an interval join within each document.

Positions come without a regex position function: the text split at a pattern gives the gaps,
all extracted matches give the rest, and running sums of their lengths give the starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orderlens.llm.common import free_name, saved

# Code points between two parts that still are one credential.
SCOPE = 200
MASK = "[SECRET]"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_NAMES = _either_case("(password|passwd|secret|token|api_?key)")
_LOGIN = _either_case("(?:user|username|login|account|client_?id|access_?key_?id|key_?id)")
_JOIN = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = _NAMES + _JOIN + r"([A-Za-z0-9+/_.=-]+)"

# Kind: order among equal starts, role, strong, pattern, group that is measured, its least
# length, and a pattern that each text with a match of that length contains.
KINDS = {
    "assign": (0, "secret", True, _ASSIGN, 2, 12, _NAMES + _JOIN + r"[A-Za-z0-9+/_.=-]{12}"),
    "access": (1, "identifier", True, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    "hex": (2, "secret", True, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    "identity": (3, "identifier", False, _LOGIN + _JOIN + r"[A-Za-z0-9_.@-]{3,}", 0, 3, None),
    "endpoint": (4, "endpoint", False, r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\"'<>]+", 0, 8, None),
    "opaque": (
        5,
        "secret",
        False,
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}",
        0,
        20,
        None,
    ),
}


def _candidate(text: Column) -> Column:
    """True for each text that holds a part of any kind."""
    found = F.lit(False)
    for *_, pattern, _, _, test in KINDS.values():
        found = found | text.rlike(test or pattern)
    return found


def _lengths(text: Column) -> Column:
    """Per kind: the lengths of gaps, of matches and of the measured group."""
    kinds = []
    for kind, (*_, pattern, group, _, test) in KINDS.items():
        size = lambda values: F.transform(values, F.length)
        whole = size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        measured = whole if not group else size(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
        zipped = F.arrays_zip(
            size(F.split(text, pattern, -1)).alias("gap"), whole.alias("size"), measured.alias("measured")
        )
        kinds.append(F.when(text.rlike(test or pattern), F.struct(F.lit(kind).alias("kind"), zipped.alias("found"))))
    return F.array_compact(F.array(*kinds))


def _spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, strong) from rows (row, kinds), weak kinds as far as linked."""
    table = F.create_map(
        *[
            x
            for kind, (order, role, strong, _, _, least, _) in KINDS.items()
            for x in (
                F.lit(kind),
                F.struct(
                    F.lit(order).alias("order"),
                    F.lit(role).alias("role"),
                    F.lit(strong).alias("strong"),
                    F.lit(least).alias("least"),
                ),
            )
        ]
    )
    before = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = (
        rows.select("row", F.explode("kinds").alias("k"))
        .select("row", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("pos", "f"))
        .select("row", "kind", "pos", "f.gap", "f.size", "f.measured")
        .withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before))
        .filter("size is not null")
        .withColumn("is", table[F.col("kind")])
        .filter("measured >= is.least")
        .select(
            "row",
            "kind",
            "is.order",
            "is.role",
            "is.strong",
            (F.col("end") - F.col("size")).cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
        )
    )
    # A weak part that overlaps a strong one is that one.
    line = W.partitionBy("row").orderBy("start", "order")
    each = each.withColumns(
        {
            "reached": F.max(F.when(F.col("strong"), F.col("end"))).over(line.rowsBetween(W.unboundedPreceding, -1)),
            "next": F.min(F.when(F.col("strong"), F.col("start"))).over(line.rowsBetween(1, W.unboundedFollowing)),
        }
    )
    parts = saved(
        each.filter(
            F.col("strong")
            | ~(F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
        ).drop("reached", "next"),
        "parts",
    )
    bucket = lambda at: F.floor(at / F.lit(SCOPE))
    weak = parts.filter("not strong").withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("start") - SCOPE), bucket(F.col("end") + SCOPE)))
    )
    other = parts.select(
        "row",
        F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))).alias("bucket"),
        F.col("role").alias("other_role"),
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
    )
    linked = (
        weak.alias("w")
        .join(
            other.alias("o"),
            (F.col("w.row") == F.col("o.row"))
            & (F.col("w.bucket") == F.col("o.bucket"))
            & (F.col("role") != F.col("other_role"))
            & (F.col("other_start") - F.col("end") <= SCOPE)
            & (F.col("start") - F.col("other_end") <= SCOPE),
            "left_semi",
        )
        .select("row", "kind", "order", "start", "end", "strong")
        .distinct()
    )
    return parts.filter("strong").select("row", "kind", "order", "start", "end", "strong").unionByName(linked)


def _listed(spans: Column) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _collected(spans: DataFrame) -> DataFrame:
    """One row per document that has spans, in order of start and kind."""
    return spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end", "strong"))).alias("found")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base, spans.

    `base` lists the strong matches as kind:start:end in code points, end exclusive, by start
    and then kind; `spans` those and the linked weak ones. Null and empty texts have none;
    repeated rows come out each. Documents without any part are not shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = saved(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.when(_candidate(F.col("text")), _lengths(F.col("text"))).alias("kinds"))
        .withColumn("row", F.monotonically_increasing_id()),
        "lengths",
    )
    met = rows.filter("kinds is not null").select("row", "doc_id")
    found = met.join(_collected(_spans(rows.filter("kinds is not null"))), "row", "left").drop("row")
    none = rows.filter("kinds is null").select("doc_id", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    spans = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return (
        found.unionByName(none)
        .select("doc_id", spans.alias("found"))
        .select(
            "doc_id",
            count("assign").alias("n_assign"),
            count("access").alias("n_access"),
            count("hex").alias("n_hex"),
            _listed(F.filter("found", lambda s: s["strong"])).alias("base"),
            _listed(F.col("found")).alias("spans"),
        )
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The documents, every reported span replaced by `mask`; other columns as they are.

    Documents without a part of any kind pass through; null texts stay null.
    """
    text, row, kinds = F.col(f"`{text_col}`"), free_name(docs, "row"), free_name(docs, "kinds")
    test = F.coalesce(_candidate(text), F.lit(False))
    held = saved(
        docs.filter(test).withColumn(kinds, _lengths(text)).withColumn(row, F.monotonically_increasing_id()), "held"
    )
    spans = _spans(held.select(F.col(row).alias("row"), F.col(kinds).alias("kinds")))
    reach = F.max("end").over(W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    # Of overlapping spans the later begins where the earlier ends.
    cut = (
        spans.withColumn("reach", F.coalesce(reach, F.lit(0)))
        .filter("end > reach")
        .withColumn("joins", F.col("start") < F.col("reach"))
        .withColumn("start", F.greatest("start", "reach"))
    )
    found, owner = free_name(docs, "found"), free_name(docs, "owner")
    per_row = cut.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "joins"))).alias(found))
    joined = held.join(per_row.withColumnRenamed("row", owner), F.col(row) == F.col(owner), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda acc, s: F.struct(
        F.concat(
            acc["out"],
            F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
            F.when(s["joins"], F.lit("")).otherwise(F.lit(mask)),
        ).alias("out"),
        s["end"].alias("at"),
    )
    masked = F.aggregate(
        F.col(found),
        start,
        piece,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    new = F.when(F.col(found).isNull(), text).otherwise(masked)
    redacted = joined.withColumn(text_col, new).select([F.col(f"`{c}`") for c in docs.columns])
    return docs.filter(~test).unionByName(redacted)
