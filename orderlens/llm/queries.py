"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import bpe, exact_dedup, jaccard, language, lexical, line_dedup, merkle, neighbours
from orderlens.llm import packing, ppm, secret_scan, simhash, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_bpe_round_trip(spark, sf_dir):
    coded = bpe.encode_and_decode(documents(spark, sf_dir), WORD_BPE)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark, sf_dir):
    found = line_dedup.drop_recurring_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op5_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), BYTE_BPE, BYTE_RANKS)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op7_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir), PIECES)


def op8_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op9_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark, sf_dir):
    return ppm.score_texts(documents(spark, sf_dir))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf([*[F.col(n) for n in names[:-1]], F.translate("text", UPPER, LOWER)])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    manifest = merkle.build(documents(spark, sf_dir), names, "source", "doc_id", F.when(chosen, tampered))
    found = merkle.proofs(manifest).withColumn("folded_root", merkle.fold(F.coalesce("claim", "leaf"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_bpe_round_trip,
        op3_line_dedup,
        op4_secret_scan,
        op5_packing,
        op6_substring_dedup,
        op7_language_id,
        op8_simhash_dedup,
        op9_nearest_neighbours,
        op10_lm_scoring,
        op11_merkle_manifest,
        op12_lexical_search,
        op13_jaccard_join,
    )
}
