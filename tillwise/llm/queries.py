"""Registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwise.llm import (
    ball_tree,
    language_id,
    license_scan,
    mixing,
    nearest,
    packing,
    prefix_trie,
    quality,
    quotations,
    simhash_dedup,
    substring_dedup,
    vector_codes,
    warc,
)
from tillwise.llm.common import SPACES, table
from tillwise.llm.oracle import ORACLE  # noqa: F401  the DuckDB text of queries that SQL can express
from tillwise.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def vocabulary() -> tuple[str, str]:
    """Files of one public vocabulary: for the tokenizers library, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, ["doc_id"], *vocabulary())
    return pieces.select(
        "row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    drawn = mixing.mix(docs, ["doc_id"], undrawn=True)
    return mixing.taken(drawn).select("row.doc_id", "size", "source_size", "target", "taken", "shard", "place")


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tillwise-stage/warc-{uuid4()}"
    warc.write_archives(warc.with_revisits(table(spark, folder, "pages"), least_bytes=0), path)
    found = warc.read_archives(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept", "quality")


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.classify(docs, profiles, ["doc_id"])
    out = F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out")
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", out, "lang_pred", "score")


@query
def op8_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = substring_dedup.remove_repeats(docs, window=20)
    words = F.regexp_replace(F.trim(F.coalesce("text", F.lit("")), F.lit(SPACES)), r"[\x20\x09-\x0D]+", " ")
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query
def op10_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.in_order(quotations.conversations(table(spark, folder, "conversations")))


@query
def op11_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations")).drop("k1", "k2")


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"), parts=4, entries=256, rounds=4)
    rows = vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error")
    return rows.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))
