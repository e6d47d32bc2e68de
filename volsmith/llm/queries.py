"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsmith.llm import (
    bpe, collocations, licenses, lines, near_dedup, packing, paragraphs, quality, secret_scan, sentencepieces, vector_codes, warc,
)
from volsmith.llm import exact_dedup as exact
from volsmith.llm.common import text_of
from volsmith.llm.oracles import ORACLES  # noqa: F401
from volsmith.session import stage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN)
    numbers = pieces.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return packing.pack(numbers).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(text_of(), 256))
    return exact.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.near_verdicts(docs, percent=85).select(
        F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    found = F.split("spans", ",")
    kind_of = lambda s: F.substring_index(s, ":", 1)
    count = lambda k: F.size(F.filter(found, lambda s: kind_of(s) == k)).cast("long")
    base = F.array_join(F.filter(found, lambda s: kind_of(s).isin(kinds)), ",")
    scanned = secret_scan.secret_scan(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
                          F.sha2(base, 256).alias("base_sha256"), "spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = stage(quality.rule_columns(docs).select(
        F.struct("row.doc_id").alias("row"), "host", *quality.RULES), "rules")
    rejected = quality.host_verdicts(judged.select("host", "base_failed"))
    return quality.with_hosts(judged, rejected, ["doc_id"]).select("doc_id", *quality.RULES, "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", *licenses.ADDED)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), path, end_id=2, decoded=True)
    decimal = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"), also=["label"])
    errors = vector_codes.error_by(coded.rows, "label")
    return errors.select("vec_id", "code", "error", "label_error",
                         F.lit(vector_codes.fingerprint(coded.codebooks)).alias("codebooks_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}

