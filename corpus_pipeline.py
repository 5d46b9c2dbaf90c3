"""Pipeline over the corpus: each stage applies one operator to all documents that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.llm import language_id, mixing, packing, simhash_dedup, substring_dedup
from tillwise.llm.common import parts_for
from tillwise.llm.queries import vocabulary
from tillwise.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No score is too low: it falls with the length of a text and the size of its alphabet, so any bound above 0 takes clean
#: short texts of a learned language.
LEAST_SCORE = 0.0

#: The mix draws about as many documents as there are; whole shards are dealt to files of about this many.
DOCS_A_FILE = 20_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; profiles are learned from documents not held out."""
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.classify(docs, profiles, docs.columns)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (3-word shingles, at most 2 differing bits) the smallest id stays."""
    return simhash_dedup.deduplicate(docs, shingle=3, radius=2)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that also stand earlier are cut; a document of nothing else goes."""
    cut = substring_dedup.remove_repeats(docs, window=20)
    left = cut.where("n_removed = 0 or n_removed < n_words")
    return _with_text(docs, left, F.col("text"), F.col("n_removed") > 0)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard; one drawn in part is cut to its first words."""
    drawn = mixing.in_order(mixing.mix(docs, docs.columns), parts_for(docs.count(), DOCS_A_FILE, 8))
    part = F.col("words") < F.col("size")
    text = F.when(part, mixing.first_words("row.text", "words")).otherwise(F.col("row.text"))
    return _with_text(docs, drawn, text, part)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024; one row per piece of a document."""
    return packing.pack(docs, ["doc_id"], *vocabulary()).select(
        "row.doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def _with_text(docs: DataFrame, rows: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of the documents, from ``row``, with another text and, where it changed, its length."""
    length = F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    own = {"text": text, "n_chars": length}
    return rows.select(*[own.get(name, F.col(f"row.`{name}`")).alias(name) for name in docs.columns])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("simhash_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every result is written as Parquet and read again as the next stage's documents."""
    place = f"{shared_dir(spark)}/tillwise-stage/pipeline-{uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # tokens, hashes and language profiles have no counterpart in SQL; see tests/llm
