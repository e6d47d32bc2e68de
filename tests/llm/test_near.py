"""Near dedup and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_rules import DOCS, LONG, ODD
from tests.llm.test_tokens import brute_spans, check_packing
from volsmith.llm import common, near_dedup, secret_scan, shingles
from volsmith.llm.queries import QUERIES


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return own


def corpus(seed=5):
    """Groups of near copies of several sizes, copies, a passage that many texts share, short texts."""
    rng = random.Random(seed)
    texts, passage = [], words(rng, 40)
    for n, members in ((60, 60), (150, 90), (400, 25), (900, 12)):
        base = words(rng, n)
        texts += [edited(rng, base, rng.randrange(0, max(2, n // 25))) for _ in range(members)]
    texts += [[*words(rng, rng.randrange(10, 60)), *passage, *words(rng, rng.randrange(10, 60))] for _ in range(120)]
    texts += [words(rng, rng.randrange(0, 12), 6) for _ in range(120)] + [texts[3]] * 40 + [[]] * 3
    rng.shuffle(texts)
    return [(i * 7 + 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_brute(spark, tmp_path, percent):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS).repartition(6)
    frame.write.parquet(str(tmp_path / "docs"))
    found = near_dedup.near_dedup(spark.read.parquet(str(tmp_path / "docs")), percent=percent).collect()
    expected = brute.near(docs, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert 50 < len({c for _, c in expected.values()}) < len(docs) - 100


def test_near_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_near_dedup"](spark, sf).collect()}
    assert found == {d: (n, c, c == d) for d, (n, c) in brute.near(docs).items()}


def test_near_odd(spark, tmp_path):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("x")).withColumn("place", F.lit(1)).withColumn("hi", F.lit(1))
    frame.write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    found = near_dedup.near_dedup(stored).collect()
    assert len(found) == len(ODD)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"], []).append(r)
    assert {r["component_id"] for r in by_text["a b c d e"]} == {1} and sum(r["kept"] for r in by_text["a b c d e"]) == 1
    assert by_text[None][0]["n_shingles"] == 0 and by_text[None][0]["kept"] and by_text[None][0]["component_id"] == 3
    assert by_text["other"][0]["component_id"] is None and by_text["other"][0]["kept"]
    assert {r["component_id"] for t in (LONG, LONG + " ") for r in by_text[t]} == {5}
    rest = near_dedup.without_near_copies(stored)
    assert sorted(rest.columns) == sorted(frame.columns) and rest.count() == sum(r["kept"] for r in found)
    assert near_dedup.near_dedup(stored.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB éÉ\t\nx1", max_size=60), max_size=6))
def test_shingles_of_any_text(texts):
    found = list(shingles.shingle_sets(texts))
    assert [len(s) for s in found] == [len(brute.shingles(t)) for t in texts]
    for (i, a), (j, b) in [((i, a), (j, b)) for i, a in enumerate(found) for j, b in enumerate(found) if i < j]:
        assert len(np.intersect1d(a, b)) == len(brute.shingles(texts[i]) & brute.shingles(texts[j]))


def test_shingles_over_chunks():
    long_word = "q" * (shingles.CHUNK + 10)
    text = " ".join(f"W{i}" for i in range(400_000)) + " " + long_word + " a b c d e f"
    one, two, three = shingles.shingle_sets(["a b c d e f", text, "x"])
    assert len(two) == len(brute.shingles(text)) and len(np.intersect1d(one, two)) == 2 and len(three) == 1


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1100)]
    star = [(5, i) for i in range(2000, 2600)]
    loose = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(200)]
    edges = chain + star + loose + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "near dedup", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, held = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        result = function(spark, docs, sf)
        result.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality rules":
            held = {d: t for d, t in held.items() if not brute.rules(t)[5]}
        elif name == "exact dedup":
            held = {d: held[d] for d, _, _, kept, _ in brute.exact(held.items()) if kept}
        elif name == "near dedup":
            held = {d: held[d] for d, (_, c) in brute.near(held.items(), 80).items() if c == d}
        elif name == "secret scans":
            for d, t in held.items():
                at = 0
                parts = []
                for s, n, e in brute_spans(t):
                    if s >= at:
                        parts += [t[at:s], f"[{secret_scan.RULES[n].kind}]"]
                    at = max(at, e)
                held[d] = "".join([*parts, t[at:]])
        if k < 4:
            assert docs.columns == names and {r["doc_id"]: r["text"] for r in docs.collect()} == held, name
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(held)
    assert check_packing(packed, 1024) >= sum(r["length"] for r in packed) / 1024
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    odd = [(d, t, lang, None, n) for d, t, lang, _, n in ODD]  # no hosts: texts are judged alone
    frame = spark.createDataFrame(odd, DOCS)
    kept = {
        "quality rules": [d for d, t, *_ in ODD if not brute.rules(t)[5]],
        "exact dedup": [2, 4, None, 6, 7, 8, 9, 10, 11, 12],  # None: the text "other"
        "near dedup": [1, 3, 4, None, 5, 8, 9, 10, 11, 12],
        "secret scans": [d for d, *_ in ODD],
    }
    for k, rows in enumerate((frame, frame.limit(0))):
        rows.write.parquet(str(tmp_path / f"in{k}"))
        for n, (name, function) in enumerate(corpus_pipeline.STAGES):
            docs = spark.read.parquet(str(tmp_path / f"in{k}"))
            function(spark, docs, "").write.parquet(str(tmp_path / f"out{k}{n}"))
            back = spark.read.parquet(str(tmp_path / f"out{k}{n}"))
            found = back.collect()
            if name == "best-fit packing":
                firsts = [r["doc_id"] for r in found if r["piece"] == 0]
                assert Counter(firsts) == Counter([] if k else [d for d, *_ in ODD])
                continue
            assert back.columns == frame.columns
            assert Counter(r["doc_id"] for r in found) == Counter([] if k else kept[name]), name
            by_text = {(d, t): (lang, source, n_chars) for d, t, lang, source, n_chars in odd}
            for r in found:
                n_chars = len(r["text"]) if name == "secret scans" and r["text"] is not None else by_text[r["doc_id"], r["text"]][2]
                assert (r["lang"], r["source"], r["n_chars"]) == (*by_text[r["doc_id"], r["text"]][:2], n_chars)
