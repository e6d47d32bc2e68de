"""SentencePiece, vector codes and collocations against the library, brute force and SQL, and odd inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import connect, difference
from tests.llm.test_rules import DOCS, LONG, ODD
from volsmith.llm import collocations, sentencepieces, vector_codes
from volsmith.llm.oracles import ORACLES
from volsmith.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_collocations"])
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


# --- sentence pieces ---------------------------------------------------------------------------------


def test_pieces_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for d, t in docs:
        ids = [*library.encode(t or ""), 2]
        expected[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_sentencepiece"](spark, SF).collect()} == expected


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab ▁\t\n\r　é漢<0x41>s/\x00", max_size=30))
def test_words_make_up_any_text(text):
    model = Path(MODEL).read_bytes()
    ends = sentencepieces.borders(model)
    assert ends == "▁\t\n"
    words = sentencepieces.marked_words(text, ends) if text else []
    assert "".join(words) == ("▁" + text.replace(" ", "▁") if text else "")
    found = [i for w in sentencepieces.segmented(model, words) for i in np.frombuffer(w, "<i4").tolist()]
    assert found == sentencepieces._processor(model).encode(text)


def test_pieces_odd(spark, library):
    more = [(20, "  two  blanks ", "en", "s", 1), (21, "▁ mark ▁▁", "en", "s", 1), (22, "<s> </s> <unk>", None, None, None),
            (23, "x" * 30_000, "en", "s", 1), (24, " ", "en", "s", 1)]
    frame = spark.createDataFrame([*ODD, *more], DOCS).withColumn("slice", F.lit(1)).withColumn("token_ids", F.lit("x"))
    found = sentencepieces.encode(frame, MODEL, end_id=2, decoded=True, chars=500)
    expected = Counter((d, (*library.encode(t or ""), 2), library.decode([*library.encode(t or ""), 2])) for d, t, *_ in [*ODD, *more])
    assert Counter((r[0], tuple(r[1]), r[2]) for r in found.collect()) == expected
    back = sentencepieces.decode(found.drop("decoded").withColumn("extra", F.lit(1)), MODEL)
    assert back.where(F.col("doc_id") == 5).first()["decoded"] == LONG
    assert sentencepieces.encode(frame.limit(0), MODEL).count() == 0
    assert sentencepieces.decode(spark.createDataFrame([(1, None), (2, [])], "k int, token_ids array<int>"), MODEL).collect() == [
        (1, None, ""), (2, [], "")]


# --- vector codes ------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """(codes by key, codebooks) of (key, vector) with whole-number loops."""
    fine = [(k, [int(np.floor(4096 * x)) for x in v]) for k, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(fine[0][1]) // parts if fine else 0
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v in sorted(fine)[:entries]] for p in range(parts)]

    def nearest(x, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return min(range(len(book)), key=lambda i: (gaps[i], i)), min(gaps)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v in fine:
                members[nearest(cut(v, p), books[p])[0]].append(cut(v, p))
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for k, v in fine:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{n:02x}" for n, _ in near), sum(g for _, g in near)))
    return out, books


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 3, 8, 4096]))
def test_walk_is_exact(seed, n, dims, subtree):
    random = np.random.default_rng(seed)
    leaves = np.unique(random.integers(-3, 3, (n, dims)), axis=0)
    entries = random.integers(-3, 3, (5, dims))
    usual, vector_codes.SUBTREE = vector_codes.SUBTREE, subtree
    try:
        near, distance = vector_codes.walk(leaves, entries)
    finally:
        vector_codes.SUBTREE = usual
    gaps = ((leaves[:, None, :] - entries[None]) ** 2).sum(-1)
    assert near.tolist() == gaps.argmin(1).tolist() and distance.tolist() == gaps.min(1).tolist()


VECTORS = "vec_id long, embedding array<double>, label int, code string, row int"


def test_vectors_odd(spark):
    random = np.random.default_rng(5)
    rows = [(i, (random.integers(-3, 4, 16) / 7).tolist(), i % 3 if i % 5 else None, "old", 1) for i in range(60)]
    rows += [(100 + i, [0.25] * 16, 1, "old", 1) for i in range(40)]  # a group of copies
    rows += [(7, [1.0] * 16, 0, "old", 1), (200, None, 1, "o", 1), (201, [None] + [0.0] * 15, 1, "o", 1),
             (202, [float("nan")] * 16, 1, "o", 1), (203, [float("-inf")] + [0.0] * 15, None, "o", 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    coded = vector_codes.compress(frame, also=["label", "code"])
    expected, books = brute_codes([r[:2] for r in rows])
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in coded.rows.collect()) == Counter(expected)
    assert coded.codebooks.tolist() == books
    text = ",".join(str(c) for book in books for e in book for c in e)
    assert vector_codes.fingerprint(coded.codebooks) == hashlib.sha256(text.encode()).hexdigest()
    sums = defaultdict(int)
    for r in coded.rows.collect():
        sums[r["label"]] += r["error"]
    summed = vector_codes.error_by(coded.rows, "label").collect()
    assert None in sums and all(r["label_error"] == sums[r["label"]] for r in summed) and len(summed) == 101


def test_few_vectors_and_bad_ones(spark):
    few = spark.createDataFrame([(1, [0.5] * 8), (2, [-0.5] * 8)], "vec_id long, embedding array<float>")
    assert [r["code"] for r in vector_codes.compress(few).rows.orderBy("vec_id").collect()] == ["00" * 8, "01" * 8]
    none = vector_codes.compress(few.limit(0))
    assert none.rows.count() == 0 and none.codebooks.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(few.selectExpr("vec_id", "slice(embedding, 1, cast(9 - vec_id as int)) as embedding"))


# --- collocations ------------------------------------------------------------------------------------


def brute_collocations(rows, best=2000, least=10, inside=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[k:k + 2] for p, a in candidates.items() if len(p) == 3 for k in (0, 1) if 100 * a >= inside * f[p[k:k + 2]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], totals[lang], -s[0]) for i, s in enumerate(sorted(scored)[:best])]
    return sorted(out)


@pytest.mark.parametrize("best, first", [(5, 1), (40, 1), (2000, 2)])
def test_collocations_by_rounds(spark, best, first):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    found = collocations.collocations(docs, best=best, first=first, chars=100_000)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, best)


def test_collocations_odd(spark):
    said = ["a b c. A B\tc a b! É é É\x0bé é  é", "x " * 40, None, "", "a b c d " * 12, "b c e " * 15, LONG]
    rows = [(i, t, lang, None, None) for i, t in enumerate(said * 2) for lang in ("en", None, "")]
    frame = spark.createDataFrame([*rows, *ODD], DOCS).withColumn("rank", F.lit(1)).withColumn("slice", F.lit("x"))
    expected = brute_collocations([(r[2], r[1]) if r[2] != "" else ("", r[1]) for r in [*rows, *ODD] if r[2] != ""])
    found = [tuple(r) for r in collocations.collocations(frame, chars=1000).collect()]
    assert sorted(r for r in found if r[0]) == expected and any(r[0] == "" for r in found)
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame.where("doc_id = 3")).count() == 0
