"""Repeated paragraphs and fuzzy lines against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

from tests.llm.test_near import edited, words
from tests.llm.test_rules import DOCS, LONG, ODD
from volsmith.llm import lines, paragraphs
from volsmith.llm.queries import QUERIES


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def bounded_distance(a, b, most):
    """The edit distance of two texts, or more than ``most``; only places that near distances reach are looked at."""
    if a == b:
        return 0
    far, row = most + 1, {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            now[j] = min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1])) if j else i
        row = now
        if min(row.values()) > most:
            return far
    return row.get(len(b), far)


def groups_of(items, alike):
    """{item number: smallest item number of its component}, by all pairs."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if find(i) != find(j) and alike(items[i], items[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(items))]


def test_bands():
    for threshold, count in ((0.8, 1), (0.8, 2), (0.95, 4)):
        bands = paragraphs.tune_bands(threshold, count)
        assert 1 - (1 - threshold**count) ** bands >= paragraphs.RECALL > 1 - (1 - threshold**count) ** (bands - 1)


def placed(text):
    """(word, start, end) of a text, A-Z in lower case."""
    return [(re.sub("[A-Z]", lambda x: x.group().lower(), m.group()), m.start(), m.end())
            for m in re.finditer("[^\x20\x09-\x0D]+", text or "")]


def repeated_windows(docs, size):
    """{doc: starts and ends of the runs of so many words that stand in another place too}, by whole texts."""
    seen = defaultdict(list)
    for d, t in docs:
        own = placed(t)
        for i in range(len(own) - size + 1):
            seen[tuple(w for w, *_ in own[i:i + size])].append((d, own[i][1], own[i + size - 1][2]))
    by_doc = defaultdict(list)
    for places in seen.values():
        if len({d for d, *_ in places}) > 1:
            for d, start, end in places:
                by_doc[d].append((start, end))
    return by_doc


def shingles_of(text):
    words = [w for w, *_ in placed(text)]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def check_repeats(found, docs, least_recall=0.9):
    """Passages of 50 words are found, all that is found repeats, texts without repeats are left alone."""
    found, texts = [tuple(r) for r in found], dict(docs)
    assert len(set(found)) == len(found)
    spans, groups = defaultdict(list), defaultdict(list)
    for d, n, start, end, first, first_n, size, kept in found:
        spans[d].append((start, end))
        groups[first, first_n].append((d, n, shingles_of(texts[d][start:end]), size, kept))
    windows = repeated_windows(docs, 50)
    hit = [any(start <= s and e <= end for s, e in spans[d]) for d, own in windows.items() for start, end in own]
    assert hit and sum(hit) >= least_recall * len(hit) and set(windows) <= set(spans)
    assert set(spans) <= set(repeated_windows(docs, 16))
    for first, members in groups.items():
        assert {m[3] for m in members} == {len(members)} and len(members) > 1
        assert [m[:2] for m in members if m[4]] == [first] == [min(m[:2] for m in members)]
        for d, n, own, *_ in members:
            assert any(100 * len(own & o) >= paragraphs.PERCENT * len(own | o) for e, m, o, *_ in members if (e, m) != (d, n))
    return sum(hit) / len(hit)


def test_repeats_across_line_breaks(spark, tmp_path):
    rng = random.Random(11)
    passages = [words(rng, n) for n in (52, 60, 80, 140)]
    docs, holders = [], {}
    for i in range(120):
        body = words(rng, rng.randrange(0, 120))
        if i % 3:
            body[len(body) // 2:len(body) // 2] = passages[i % 4]
            holders[i] = i % 4
        docs.append((i, "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in body)))
    spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    found = paragraphs.repeated_paragraphs(spark.read.parquet(str(tmp_path / "d")))
    assert check_repeats(found.collect(), docs) > 0.9
    assert {r["doc_id"] for r in found.collect()} == set(holders)
    gone = {r["doc_id"] for r in paragraphs.removals(found).collect()}
    assert len(set(holders) - gone) == len(passages)


def test_repeats_near_copies(spark, tmp_path):
    rng = random.Random(12)
    base = words(rng, 200)
    docs = [(0, " ".join(base)), (99, " ".join(words(rng, 200)))]
    docs += [(i, " ".join(edited(rng, base, 9))) for i in range(1, 13)]
    spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS).write.parquet(str(tmp_path / "d"))
    found = [tuple(r) for r in paragraphs.repeated_paragraphs(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert {r[0] for r in found} == set(range(13))
    groups = defaultdict(list)
    for d, _, start, end, *group in found:
        groups[tuple(group[:2])].append(frozenset(shingles_of(dict(docs)[d][start:end])))
    assert any(a != b and 5 * len(a & b) >= 4 * len(a | b) for own in groups.values() for a in own for b in own)
    # A pair at the threshold is never in two groups: the recall of the bands is that of all pairs here.
    every = [(a, g) for g, own in groups.items() for a in own]
    close = [g == h for a, g in every for b, h in every if a != b and 5 * len(a & b) >= 4 * len(a | b)]
    assert sum(close) >= 0.95 * len(close)


def test_repeats_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_repeats(QUERIES["op1_substring_dedup"](spark, sf).collect(), docs)


def test_repeats_stage_only_what_texts_share(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    bodies = [words(rng, 300) for _ in range(40)]
    bodies[7][100:160] = bodies[23][30:90]
    spark.createDataFrame([(i, " ".join(b), None, None, None) for i, b in enumerate(bodies)], DOCS).write.parquet(str(tmp_path / "d"))
    staged, plain = {}, paragraphs.stage
    monkeypatch.setattr(paragraphs, "stage", lambda df, name: staged.setdefault(name, []).append(plain(df, name)) or staged[name][-1])
    found = paragraphs.repeated_paragraphs(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {r["doc_id"] for r in found} == {7, 23}
    rows = {name: sum(t.count() for t in tables) for name, tables in staged.items()}
    # Paragraphs of one text overlap and have runs of words in common; that makes no candidates.
    assert rows["paragraphs"] > 400 and rows["classes"] < 40 and rows["sets"] < 20


def test_outlines_lose_no_link():
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, (400, paragraphs.RUNS), dtype=np.uint64)
    other = base.copy()
    for i, row in enumerate(other):
        row[:i % 8] = rng.integers(0, 1 << 63, i % 8, dtype=np.uint64)
    good = paragraphs.linked(base, other, 80)
    jaccard = [len({*a} & {*b}) / len({*a} | {*b}) for a, b in zip(base.tolist(), other.tolist())]
    assert good.tolist() == [j >= 0.8 for j in jaccard] and good.any() and not good.all()
    at = np.arange(400) * paragraphs.RUNS
    bits = paragraphs.outlines(np.concatenate([base.ravel(), other.ravel()]), np.concatenate([at, at + base.size])).view(np.uint64)
    apart = bits[:400] ^ bits[400:]
    most = paragraphs.most_apart(80)
    assert (np.bitwise_count(apart[good]) <= most).all()
    masks = [np.uint64(sum(1 << j for j in range(part, 64, most + 1))) for part in range(most + 1)]
    assert np.any([apart[good] & m == 0 for m in masks], axis=0).all()


def test_repeats_odd(spark, tmp_path):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("x")).withColumn("start", F.lit(1)).withColumn("hi", F.lit(1))
    frame.write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    found = [tuple(r) for r in paragraphs.repeated_paragraphs(stored).collect()]
    own = {d: sorted(r[1:4] for r in found if r[0] == d) for d in (5, 6, 7)}
    assert {r[0] for r in found} == {5, 6, 7} and own[5] == own[6] == own[7] and own[5][0][0] == 0
    assert {r[6] for r in found} == {3} and all(r[7] == (r[0] == 5) for r in found)
    assert paragraphs.repeated_paragraphs(stored.limit(0)).count() == 0
    line = " ".join(f"É{i}" for i in range(30))
    same = spark.createDataFrame([(None, line, None, None, None)] * 2 + [(4, line, None, None, None)], DOCS)
    same.write.parquet(str(tmp_path / "same"))
    found = paragraphs.repeated_paragraphs(spark.read.parquet(str(tmp_path / "same"))).collect()
    firsts = [r for r in found if r["paragraph"] == 0]
    assert len(firsts) == 3 and [r["doc_id"] for r in firsts if r["kept"]] == [4]
    assert all(len(line[r["start"]:r["end"]].split()) == 24 for r in firsts)


def plain_lines(docs):
    """All lines with a letter or digit: (key, number, normalised)."""
    own = []
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            said = regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")
            if said:
                own.append((d, n, said))
    return own


def fuzzy_by_all_pairs(own, similarity=lines.SIMILARITY):
    """Groups by the edit distances of all pairs of distinct lines whose lengths allow a link."""
    distinct = sorted({s for *_, s in own}, key=len)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    letters = [Counter(s) for s in distinct]
    for j, longer in enumerate(distinct):
        most = int((1 - similarity) * len(longer) + 1e-9)
        for i in range(j - 1, -1, -1):
            if len(longer) - len(distinct[i]) > most:
                break
            # Letters that only one of them has must be changed, put in or left out.
            if find(i) != find(j) and (letters[j] - letters[i]).total() <= most and bounded_distance(distinct[i], longer, most) <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    group = {s: find(i) for i, s in enumerate(distinct)}
    first, roots = {}, []
    for i, (*_, s) in enumerate(own):
        roots.append(first.setdefault(group[s], i))
    return {(d, n, own[roots[i]][0], own[roots[i]][1], roots.count(roots[i]), i == roots[i])
            for i, (d, n, _) in enumerate(own) if roots.count(roots[i]) > 1}


def test_lines_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    bases = [words(rng, n) for n in (6, 25, 45)]
    docs = []
    for i in range(40):
        own = [words(rng, rng.randrange(1, 30)) for _ in range(2)]
        own += [edited(rng, b, rng.choice([0, 0, 1])) for b in bases if rng.random() < 0.5]
        rng.shuffle(own)
        docs.append((i, "\n".join(rng.choice(["", " - ", "\t"]) + rng.choice([" ", ", "]).join(x) for x in own) + "\n \n!!"))
    spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    found = lines.fuzzy_lines(spark.read.parquet(str(tmp_path / "d"))).collect()
    expected = fuzzy_by_all_pairs(plain_lines(docs))
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert {r[3] for r in expected} and any(not r[5] for r in expected)


def test_lines_query(spark, sf):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op2_line_dedup"](spark, sf).collect()
    assert {tuple(r) for r in found} == fuzzy_by_all_pairs(plain_lines(docs)) and found


def test_lines_odd(spark, tmp_path):
    frame = spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("x")).withColumn("code", F.lit(1)).withColumn("line", F.lit(1))
    frame.write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    found = [tuple(r) for r in lines.fuzzy_lines(stored).collect()]
    of_long = sorted(r for r in found if r[0] in (5, 6, 7))
    assert of_long == [(5, 0, 5, 0, 3, True), (6, 0, 5, 0, 3, False), (7, 0, 5, 0, 3, False)]
    small = [r for r in found if r[0] in (1, 2, None)]
    assert len(small) == 4 and {r[2:5] for r in small} == {(1, 0, 4)} and sum(r[5] for r in small) == 1
    assert sorted(r for r in found if r[0] == 9) == [(9, 0, 9, 0, 2, True), (9, 1, 9, 0, 2, False)]
    assert lines.fuzzy_lines(stored.limit(0)).count() == 0
