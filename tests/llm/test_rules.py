"""Exact dedup, quality rules and license scan against brute force, and odd inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from volsmith.llm import exact_dedup, licenses, quality
from volsmith.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
ODD = [
    (1, "a b c d e", "en", "s", 9), (2, "a b c d e", None, "s", 9), (2, "a b c d e", None, "s", 9), (3, None, None, None, None),
    (4, "", "en", "s", 0), (None, "a b c d e", "en", "s", 9), (None, "other", None, None, None), (5, LONG, "en", "s", 1),
    (6, LONG, "en", "t", 1), (7, LONG + " ", "en", "t", 1), (8, " \n\t ", "en", "t", 4), (9, "É é\nÉ é\n\nx", "fr", "t", 9),
    (10, "CC-by cc BY All rights\nreserved general public LICENSE cc by", "en", "u", 9),
    (11, "Licensed  under the APACHE license; version 2.0!", "en", "u", 9), (12, "All rights reservedé", "en", "u", 9),
]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_exact_query(spark, sf, docs):
    found = QUERIES["op4_exact_dedup"](spark, sf)
    assert set(map(tuple, found.collect())) == brute.exact(docs)
    assert found.count() == len(docs)


def test_exact_odd(spark):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("old")).withColumn("row", F.lit(1)).withColumn("full", F.lit(2))
    found = exact_dedup.exact_dedup(frame)
    assert sorted(found.columns) == sorted([*frame.columns, "keep_id", "group_size"])
    got = rows(found, "doc_id", "keep_id", "group_size", "kept")
    by_id = {}
    for d, k, n, kept in got:
        by_id.setdefault(d, []).append((k, n, kept))
    assert len(got) == len(ODD)
    assert by_id[1] == [(2, 4, False)] and sorted(by_id[2]) == [(2, 4, False), (2, 4, True)]
    assert by_id[3] == [(4, 2, False)] and by_id[4] == [(4, 2, True)]
    assert by_id[5] == [(6, 2, False)] and by_id[7] == [(7, 1, True)]
    assert sorted(by_id[None], key=repr) == sorted([(2, 4, False), (None, 1, True)], key=repr)
    assert exact_dedup.exact_dedup(frame.limit(0)).count() == 0


def test_exact_hot_group_and_equal_prefixes(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.concat(F.lit("p" * 64), F.lpad((F.col("id") % 1500).cast("string"), 5, "0"))).alias("text"))
    plain = [tuple(r) for r in frame.collect()]
    found = rows(exact_dedup.exact_dedup(frame), "doc_id", "keep_id", "group_size", "kept")
    assert found == sorted(((d, k, n, kept) for d, k, n, kept, _ in brute.exact(plain)), key=repr)


def test_quality_query(spark, sf, docs):
    found = {r["doc_id"]: tuple(r)[1:7] for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert found == {d: brute.rules(t) for d, t in docs}


def test_quality_odd(spark):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("x")).withColumn("host", F.lit(1)).withColumn("row", F.lit(1))
    found = quality.quality_rules(frame)
    assert found.count() == len(ODD)
    got = rows(found, "text", *quality.RULES)
    assert got == sorted(((t, *brute.rules(t)) for _, t, *_ in ODD), key=repr)
    assert quality.quality_rules(frame.limit(0)).count() == 0


def test_windows_that_overlap(spark):
    texts = ["a a a a", "a b a b a b", "a b c a b c d", "a b c x a b c", "a b", "a a a", "x y z w x y z w v"]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["text"]: r["n_repeat_words"] for r in quality.quality_rules(frame).collect()}
    assert got == {t: brute.rules(t)[4] for t in texts}


def test_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    table = [(i, good if i % 10 else "junk", "en", "fine", 0) for i in range(500)]
    table += [(1000 + i, "junk" if i % 20 else good, "en", "bad", 0) for i in range(400)]
    table += [(2000, "junk", "en", "tiny", 0), (2001, good, "en", None, 0)]
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(table, DOCS)).collect()}
    assert found[1]["kept"] and not found[0]["kept"]
    assert not found[1000 + 20]["base_failed"] and not found[1020]["kept"] and found[1020]["host_rejected"]
    assert not found[2000]["host_rejected"] and found[2001]["kept"]


def test_license_query(spark, sf, docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_licenses"](spark, sf).collect()}
    assert found == {d: brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD) for d, t in docs}
    assert any(r[5] for r in found.values())


def test_license_odd(spark):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("labels", F.lit("x")).withColumn("place", F.lit(1)).withColumn("best", F.lit(1))
    frame = frame.withColumns({"__body": F.lit(1), "__place": F.lit(2), "a.b": F.lit(3)})
    found = licenses.license_scan(frame)
    assert found.columns == [c for c in frame.columns if c not in licenses.ADDED] + licenses.ADDED
    got = rows(found, "text", *licenses.ADDED)
    expected = [(t, *brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)) for _, t, *_ in ODD]
    assert got == sorted(expected, key=repr)
    assert licenses.license_scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_thresholds(spark, threshold):
    templates = {"x": "alpha beta gamma delta epsilon", "y": "alpha beta", "z": "gamma zeta eta theta"}
    texts = ["alpha beta", "alpha gamma delta", "beta epsilon gamma\ndelta alpha", "theta eta gamma ZETA", "beta", "eta theta"]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["text"]: (r["labels"], r["score"]) for r in licenses.license_scan(
        frame, templates=templates, threshold=threshold).collect()}
    assert got == {t: brute.licenses(t, licenses.PHRASES, templates, threshold)[5:] for t in texts}
