"""A corpus pipeline: quality rules, exact dedup, near dedup, secret scans, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsmith.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from volsmith.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows that are sent to a Python worker at once. Texts and shingle sets take kilobytes a row, and the workers
#: of one stage are used again by the next, so ten thousand rows, Spark's usual number, would add up.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in an Arrow batch for the rest of the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name, "10000"))
    spark.conf.set(name, str(min(usual, BATCH_ROWS) if usual > 0 else BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host is not rejected.

    Null, empty and blank texts have no words and go; repeated rows are judged alike; a document without a
    host is judged by its text alone.
    """
    return quality.passing_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id, nulls being least.

    Of rows that repeat doc_id and text one stays. A null text counts as the empty one.
    """
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8): the least doc_id.

    A null doc_id comes after all others; of rows that repeat a doc_id the first stays. Texts without words
    are nobody's copies and stay.
    """
    small_batches(spark)
    return near_dedup.without_near_copies(docs).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets; ``n_chars`` follows the text.

    A null text stays null with its ``n_chars``; rows are treated one by one, repeated or not.
    """
    small_batches(spark)
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1,024: a row for each piece and its place.

    Null and empty texts are one piece of the end id; rows that repeat a doc_id are packed each.
    """
    small_batches(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN)
    numbers = pieces.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return packing.pack(numbers)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The last stage packs tokens, which SQL cannot express; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
