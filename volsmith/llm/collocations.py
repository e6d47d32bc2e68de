"""Phrase collocation mining: best-first growth of phrases under score bounds from prefix counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.llm.common import LOWER, UPPER, mark_words, marks, with_mark
from volsmith.llm.slices import SLICE_CHARS, sliced
from volsmith.session import stage

LEAST, BEST, UNIT = 10, 2000, 1_000_000
#: A phrase goes when a longer one that holds it has at least so many hundredths of its occurrences.
INSIDE = 50
#: Phrases of two words, in multiples of the number asked for, that the first round settles, and the growth from round to round.
FIRST, GROWTH = 2, 4
#: Bytes of ids that are counted at once.
BLOCK = 8_000_000
BREAK = "\n"
_TO_LOWER = str.maketrans(UPPER, LOWER)
_WORDS = re.compile("[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+").findall
_BREAKS = frozenset(".,;:!?\n\x0b\x0c\r")
KEYS = ["w1", "w2", "w3"]


def words_of(text: str) -> list[str]:
    """The words of a text in order, A-Z in lower case; ``BREAK`` stands for each border of pieces."""
    return [BREAK if w in _BREAKS else w for w in _WORDS(text.translate(_TO_LOWER))]


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Staged ``rows`` with an integer from 1, without gaps; one number a file split passes through a window."""
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    split = F.shiftright("place", 33)
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(split.alias("split")).agg(F.count("*").alias("size")).select(
        "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = F.col("place") - F.call_function("shiftleft", F.col("split"), F.lit(33))
    return placed.withColumn("split", split).join(sizes, "split").select(
        *rows.columns, (within + F.col("before") + 1).cast("int").alias(name))


def word_table(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, totals): ``lang``, ``word``, ``f`` and ``id`` of words with ``least`` occurrences; ``n`` of each lang."""
    counted = stage(
        parts.where(F.col("part") != BREAK).groupBy(F.col("group").alias("lang"), F.col("part").alias("word"))
        .agg(F.sum("n").alias("f")), "word-counts")
    totals = stage(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = stage(counted.where(F.col("f") >= least), "frequent")
    return stage(_numbered(frequent, "id"), "words"), totals


def coded_texts(texts: DataFrame, parts: DataFrame, words: DataFrame) -> DataFrame:
    """``codes`` of every text by the ids of ``words``; 0 stands for borders and for all rarer words."""
    known = parts.select("slice", "place", F.col("group").alias("lang"), F.col("part").alias("word")).join(
        words.select("lang", "word", "id"), ["lang", "word"]).select("slice", "place", "id")

    def recode(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c.as_py(), np.int32) for c in left.column("codes")]
        places = right.column("place").to_numpy()
        most = max((int(c.max()) for c in codes if len(c)), default=-1)
        ids = np.zeros(max(most, int(places.max()) if len(places) else -1) + 1, np.int32)
        ids[places] = right.column("id").to_numpy()
        return pa.table({"codes": pa.array([ids[c].tobytes() for c in codes], pa.binary())})

    return stage(texts.select("slice", "codes").groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(
        recode, "codes binary"), "coded")


def counted_runs(codes: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(words of each place, times) of the distinct runs of ``size`` ids without a 0."""
    count = max(len(codes) - size + 1, 0)
    whole = np.ones(count, bool)
    for k in range(size):
        whole &= codes[k:k + count] != 0
    starts = np.flatnonzero(whole)
    name = codes[starts].astype(np.int64)
    first = np.arange(len(starts))
    for k in range(1, size):
        pair = (name << np.int64(32)) | codes[starts + k].astype(np.int64)
        _, first, name, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    return [codes[starts[first] + k] for k in range(size)], times if size > 1 else np.ones(len(starts), np.int64)


def joined_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ids of several texts at a time, a 0 between two of them."""
    gap, held, size = np.zeros(1, np.int32).tobytes(), [], 0
    for batch in batches:
        for codes in batch.column(0):
            held.append(codes.as_py())
            size += len(held[-1])
            if size >= BLOCK:
                yield np.frombuffer(gap.join(held), np.int32)
                held, size = [], 0
    if held:
        yield np.frombuffer(gap.join(held), np.int32)


def runs(coded: DataFrame, size: int) -> DataFrame:
    """(w1, ..., n): runs of ``size`` frequent words, counted in each batch before anything is shuffled."""
    keys = KEYS[:size]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in joined_codes(batches):
            found, times = counted_runs(codes, size)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(w, pa.int32()) for w in found), pa.array(times, pa.int64())], names=[*keys, "n"])

    return coded.mapInArrow(count, ", ".join(f"{k} int" for k in keys) + ", n long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(UNIT a a / (left right)), by exact decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    over = (wide(a) * wide(a)).cast("decimal(30,0)") * F.lit(UNIT).cast("decimal(7,0)")
    return F.call_function("div", over, wide(left) * wide(right)).cast("long")


def scored_pairs(coded: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """All phrases of two words: lang, w1, w2, ``a``, ``l``, ``r``, ``score`` and ``bound``.

    ``bound`` limits the score of every longer phrase that begins with the pair: cut after the first
    word, a a / (l r) is at most a / l because no phrase outnumbers its rest, and a is at most the pair's count.
    """
    counted = runs(coded, 2).groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    one = words.select("lang", F.col("id").alias("w1"), F.col("f").alias("l"))
    two = words.select(F.col("id").alias("w2"), F.col("f").alias("r"))
    a, left, right = F.col("a"), F.col("l"), F.col("r")
    return stage(counted.join(one, "w1").join(two, "w2").select(
        "lang", "w1", "w2", "a", "l", "r", _score(a, left, right).alias("score"),
        _score(a, a, left).alias("bound")), "pairs")


def scored_triples(coded: DataFrame, prefixes: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """All phrases of three words that begin with one of the staged ``prefixes``, scored by their worse cut."""
    words = mark_words(prefixes.count())
    met = with_mark(runs(coded, 3), stage(marks(prefixes, "w1", "w2", words=words), "marks"), "w1", "w2", words=words)
    counted = met.where("maybe").groupBy(*KEYS).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    head = prefixes.select("lang", "w1", "w2", F.col("a").alias("a12"), F.col("l").alias("f1"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("r").alias("f3"))
    both = counted.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).withColumns({
        "early": _score(F.col("a"), F.col("f1"), F.col("a23")), "late": _score(F.col("a"), F.col("a12"), F.col("f3"))})
    by_first = F.col("early") <= F.col("late")
    return stage(both.select(
        "lang", *KEYS, "a", F.when(by_first, F.col("f1")).otherwise(F.col("a12")).alias("l"),
        F.when(by_first, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score")), "triples")


def _thresholds(histogram: DataFrame, langs: DataFrame | None, rank: int) -> DataFrame:
    """``t`` of each lang: the score of its pair of that rank, 0 where it has fewer; scores are at most UNIT."""
    below = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = histogram if langs is None else histogram.join(langs, "lang", "left_semi")
    reached = reached.withColumn("upto", F.sum("pairs").over(below))
    return stage(reached.groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("t")), "thresholds")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", best: int = BEST, least: int = LEAST,
                 inside: int = INSIDE, chars: int = SLICE_CHARS, first: int = FIRST) -> DataFrame:
    """The ``best`` phrases of two or three words of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase stands within a piece of text between two of ``.,;:!?`` or line ends; words are what blanks and tabs
    leave, A-Z in lower case. ``a`` counts its occurrences, overlaps included; cut in two, with
    counts ``l`` and ``r``, it scores floor(1000000 a a / (l r)), and its worst cut counts, the first of
    equals. Phrases of fewer than ``least`` occurrences are none, and those inside a longer one with at
    least ``inside`` hundredths of their occurrences go. Order is score, then a, both descending, then phrase.

    Pairs are all counted, then grown best first: in a round each language has a threshold, and every
    pair whose bound reaches it is extended, as is every pair that may head a triple around a pair at
    the threshold. A language is settled once ``best`` phrases at or above its threshold survive, or the
    threshold is 0; else it falls to the score of a lower pair. All counts are over all texts, ties included.

    A null language is ``und``; null and empty texts have no words; texts that repeat count again; a language
    without phrases and an empty table give no rows; other columns are not read.
    """
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    texts, parts = sliced(own, words_of, [], "text", "lang", chars)
    words, totals = word_table(parts, least)
    coded = coded_texts(texts, parts, words)
    pairs = scored_pairs(coded, words, least)
    histogram = stage(pairs.groupBy("lang", "score").agg(F.count("*").alias("pairs")), "scores")

    rank, langs, grown, triples, results = first * best, None, [], [], []
    while True:
        limits = _thresholds(histogram, langs, rank)
        if limits.isEmpty():
            break
        live = pairs.join(limits, "lang")
        top = live.where("score >= t")
        least_after = top.groupBy(F.col("w1").alias("w2")).agg(F.min("a").alias("least_after"))
        wanted = live.join(least_after, "w2", "left").where(
            (F.col("bound") >= F.col("t")) | (100 * F.col("a") >= inside * F.col("least_after")))
        for done in grown:
            wanted = wanted.join(done, ["w1", "w2"], "left_anti")
        grown.append(stage(wanted.select("lang", "w1", "w2", "a", "l"), "grown"))
        triples.append(scored_triples(coded, grown[-1], pairs, least))

        found = reduce(DataFrame.unionByName, triples)
        around = found.select("w1", "w2", "a").union(found.select("w2", "w3", "a")).groupBy("w1", "w2").agg(
            F.max("a").alias("around"))
        kept = top.join(around, ["w1", "w2"], "left").where(
            F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a")))
        columns = ["lang", *KEYS, "a", "l", "r", "score", "t"]
        alive = stage(kept.withColumn("w3", F.lit(None).cast("int")).select(*columns).union(
            found.join(limits, "lang").where("score >= t").select(*columns)), "alive")
        counts = limits.join(alive.groupBy("lang").agg(F.count("*").alias("alive")), "lang", "left")
        settled = (F.col("t") == 0) | (F.coalesce("alive", F.lit(0)) >= best)
        verdict = stage(counts.select("lang", settled.alias("settled")), "settled")
        results.append(alive.join(verdict.where("settled"), "lang", "left_semi"))
        langs = verdict.where("not settled")
        if langs.isEmpty():
            break
        rank *= GROWTH
    phrases = reduce(DataFrame.unionByName, results) if results else pairs.select(
        "lang", "w1", "w2", F.lit(0).alias("w3"), "a", "l", "r", "score")
    for key in KEYS:
        names = words.select(F.col("id").alias(key), F.col("word").alias(f"{key}_word"))
        phrases = phrases.join(names, key, "left")
    said = phrases.withColumn("phrase", F.concat_ws(" ", *[f"{k}_word" for k in KEYS]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = said.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
