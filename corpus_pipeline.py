"""The corpus pipeline: five operators, each on what the one before kept.

Languages that cannot be told go, then exact copies, then all but one of each group of
near-copies; secrets are masked; what is left is packed. Every stage is written to the shared
folder and read again, so the loss of an executor never reaches back beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import exact_dedup, language, packing, secret_scan, simhash
from orderlens.llm.common import saved
from orderlens.llm.queries import BYTE_BPE, BYTE_RANKS, PIECES, documents
from pyspark.sql import functions as F


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; learned from the labelled two thirds."""
    out = language.held_out(F.col("doc_id"), 3, 1)
    langs, weights = language.fit(docs.filter(~out).select("doc_id", "lang", "text"), PIECES)
    return language.drop_unidentified(docs, PIECES, langs, weights)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, with their token ids."""
    return packing.pack(docs, BYTE_BPE, BYTE_RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# Fingerprints and token ids are beyond SQL; a test runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
