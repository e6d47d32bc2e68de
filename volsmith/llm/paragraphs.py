"""Substring dedup: paragraphs that repeat across documents, by MinHash bands and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.llm.common import mark_words, marks, text_of, with_mark
from volsmith.llm.linking import list_components, shared_values
from volsmith.llm.shingles import WIDTH, mixed, placed_words, runs_of
from volsmith.session import ship_package, stage

#: Words of a paragraph, and on how many words to each side its first run of words has the least hash.
WORDS, REACH = 24, 6
#: Runs of five words in a paragraph.
RUNS = WORDS - WIDTH + 1
#: Rounds of ``list_components``: lists of parts of outlines are short, so few are needed.
STARS = 3
#: Words of texts that are worked on together.
BLOCK = 1 << 16
PERCENT = 80
#: Values of a band, and the share of pairs at the threshold that must meet in a band.
ROWS, RECALL = 1, 0.99
ADDED = ["paragraph", "start", "end", "group_doc_id", "group_paragraph", "group_size", "kept"]
_RANDOM = np.random.default_rng(91)
_NAMES = _RANDOM.integers(0, 1 << 63, (2, 64), dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALTS = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)


def tune_bands(threshold: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands of ``rows`` MinHash values in which ``recall`` of the pairs at ``threshold`` meet."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def paragraph_starts(runs: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Places in ``runs`` at which paragraphs begin: where a run's hash is least among its neighbours; else the first one.

    ``runs`` holds the texts one after another with ``REACH`` places of the greatest number behind each; ``first`` and
    ``n_words`` tell their first places and words. A place depends on the ``REACH`` words before it and on words of its own
    paragraph only, so a passage has the same paragraphs wherever it stands. Of equal hashes the first one counts. Two places
    are more than ``REACH`` words apart, too far for neighbours to be alike; the first word counts where no place is that near.
    """
    least = runs != _NONE
    for k in range(1, REACH + 1):
        least[k:] &= runs[k:] < runs[:-k]
        least[:-k] &= runs[:-k] <= runs[k:]
    passed = np.concatenate([[0], np.cumsum(least)])
    long = n_words >= WORDS
    first, ends = first[long], (first + n_words)[long]
    least[first] |= passed[first + REACH + 1] == passed[first]
    starts = np.flatnonzero(least)
    if not len(first):
        return starts[:0]
    text = np.searchsorted(first, starts, "right") - 1
    return starts[(text >= 0) & (starts + WORDS <= ends[text])]


def paragraphs_of(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, number, start, end, name, runs, place) of the paragraphs of some texts at a time.

    ``runs`` has the hashes of all runs of words of these texts, those of a paragraph from ``place`` on.
    """
    held, size, begun = [], 0, 0
    for own in placed_words(texts):
        held.append(own)
        size += len(own[2])
        if size > BLOCK:
            yield _of_block(held, begun)
            begun, held, size = begun + len(held), [], 0
    if held:
        yield _of_block(held, begun)


def _of_block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], begun: int) -> tuple[np.ndarray, ...]:
    counts = np.array([len(words) for *_, words in held])
    gap, edge = np.zeros(REACH, np.int64), np.zeros(REACH, np.uint64)
    begin, end = (np.concatenate([x for own in held for x in (own[i], gap)]) for i in (0, 1))
    words = np.concatenate([x for own in held for x in (own[2], edge)])
    first = np.cumsum(counts + REACH) - counts - REACH
    runs = np.concatenate([runs_of(words), np.full(WIDTH - 1, _NONE)])
    # Runs that reach beyond their text, and the places behind it.
    beyond = (first + counts)[:, None] + np.arange(1 - WIDTH, REACH)
    runs[beyond[beyond >= 0]] = _NONE
    at = paragraph_starts(runs, first, counts)
    text = np.searchsorted(first, at, "right") - 1
    number = np.arange(len(at)) - np.searchsorted(text, text)
    name = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        name += words[at + k] * _NAMES[k]
    return text + begun, number, begin[at], end[at + WORDS - 1], mixed(name).view(np.int64), runs, at


def _over_runs(function: np.ufunc, of_run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``function`` over the values of each paragraph's runs."""
    out = of_run[at]
    for k in range(1, RUNS):
        function(out, of_run[at + k], out=out)
    return out


def band_keys(runs: np.ndarray, at: np.ndarray, bands: int, rows: int = ROWS) -> list[np.ndarray]:
    """For each band a 64-bit key of every paragraph, from MinHash values of its runs."""
    keys = []
    for b in range(bands):
        key = np.full(len(at), b + 1, np.uint64)
        for r in range(rows):
            least = _over_runs(np.minimum, mixed(runs ^ _SALTS[b * rows + r]), at)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys.append(key.view(np.int64))
    return keys


def outlines(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each paragraph: one is set by each of its runs."""
    return _over_runs(np.bitwise_or, np.uint64(1) << (runs & np.uint64(63)), at).view(np.int64)


def most_apart(percent: int) -> int:
    """Runs that only one of two linked paragraphs may have, hence bits in which their outlines may differ."""
    return (100 - percent) * 2 * RUNS // (100 + percent)


def outline_parts(percent: int) -> list[Column]:
    """One part of the outline more than linked ones may have differing bits: in some part they are equal."""
    parts = most_apart(percent) + 1
    masks = [sum(1 << j for j in range(part, 64, parts)) for part in range(parts)]
    return [F.xxhash64("value", F.lit(part), F.col("outline").bitwiseAND(F.lit(mask - (mask >> 63 << 64))))
            for part, mask in enumerate(masks)]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the Jaccard similarity of the sets in each two rows reaches ``percent``."""
    def new(rows: np.ndarray) -> np.ndarray:
        out = np.ones(rows.shape, bool)
        for k in range(1, rows.shape[1]):
            out[:, k] = (rows[:, :k] != rows[:, k:k + 1]).all(1)
        return out

    own = new(x)
    common = sum((own[:, k] & (x[:, k:k + 1] == y).any(1)).astype(np.int64) for k in range(x.shape[1]))
    return 100 * common >= percent * (own.sum(1) + new(y).sum(1) - common)


def repeated_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Every paragraph that several texts hold, in copies or near copies; all but the first go.

    What a text only repeats by itself (refrains, junk) is left alone.

    Line breaks do not bound passages that are copied from text to text, so a paragraph is cut by content:
    ``WORDS`` words from each place where a run of five words has the least hash of its neighbourhood
    (``paragraph_starts``). Paragraphs overlap; of a passage of 50 words that
    repeats, 93 in 100 hold at least one whole. Two are linked when the Jaccard similarity of
    their sets of five-word shingles is at least ``percent`` hundredths; candidates share a band of
    MinHash values (``tune_bands`` sets the bands for high recall) and one part of their outlines, and are left out when
    their outlines differ in more bits than linked ones can (``most_apart``). Paragraphs whose bands no other text
    has are repeated by their own text at most and take no part. Groups are connected components. One row for each paragraph of a group: key, ``paragraph`` (its
    number in the text), ``start`` and ``end`` in code points, the group's first paragraph in order of key and number
    (``group_doc_id``, ``group_paragraph``), ``group_size`` (paragraphs), and ``kept``, true for that
    first one; ``removals`` merges what goes into spans. Equal paragraphs (up to case and white space) are one
    class from the start. Null keys
    come last; rows that repeat a key and text count as further occurrences, the first by place stays; texts
    of fewer than ``WORDS`` words, null and empty ones have no paragraphs; an empty table gives an empty result;
    other columns are not read. ``docs`` has to be a stored table.
    """
    ship_package(docs.sparkSession)
    bands = [f"b{i}" for i in range(tune_bands(percent / 100))]
    # A paragraph's name and its first band, which do not depend on each other, tell it from all others.
    numbers = ["start", "end", "name", *bands, "outline"]
    same = ["name", bands[0]]
    schema = T.StructType([
        T.StructField("place", T.LongType()), docs.schema[key], T.StructField("paragraph", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in numbers]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, number, begin, end, name, runs, at in paragraphs_of(batch.column(2).to_pylist()):
                place = pa.array(source)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(place), batch.column(1).take(place), pa.array(number.astype(np.int32)),
                     *[pa.array(c) for c in (begin, end, name, *band_keys(runs, at, len(bands)), outlines(runs, at))]],
                    names=schema.names)

    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key), text_of(text).alias("text"))
    signed = stage(placed.mapInArrow(sign, schema), "paragraphs")

    # Paragraphs with a value that another text has too, copies being one class; all others stand alone.
    shared = stage(shared_values(signed.select("place", F.explode(F.array(*bands)).alias("value")), "place"), "shared")
    words = mark_words(shared.count())
    marked, met = stage(marks(shared, "value", words=words), "marks"), signed
    for b in bands:
        met = with_mark(met, marked, b, words=words).withColumnRenamed("maybe", f"in_{b}")
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "place", "paragraph")
    classes = stage(
        met.where(reduce(or_, [F.col(f"in_{b}") for b in bands])).groupBy(*same).agg(
            F.min(order).alias("first"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"),
            *[F.min(c).alias(c) for c in (*bands[1:], "outline")])
        .withColumn("node", F.monotonically_increasing_id()), "classes")

    # Linked classes share a value, and a part of their outlines besides.
    values = _maybe_met(classes.select("node", "outline", F.explode(F.array(*bands)).alias("value")))
    parts = _maybe_met(values.select("node", "outline", F.explode(F.array(*outline_parts(percent))).alias("value")))
    open_lists = parts.groupBy("value").agg(
        F.count("*").alias("size"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor("outline").alias("apart"),
    ).where((F.col("least") != F.col("most")) & ((F.col("size") > 2) | (F.bit_count("apart") <= most_apart(percent))))
    lists = stage(parts.join(open_lists.select("value"), "value", "left_semi"), "lists")

    # The full sets of paragraphs in lists: the first occurrence of each class, read again from its document.
    nodes = stage(lists.select("node").distinct().join(classes, "node").select("node", "first.place", "first.paragraph"), "nodes")
    words = mark_words(nodes.count())
    holders = stage(marks(nodes, "place", words=words), "marks")
    wanted = stage(marks(nodes, "place", "paragraph", words=words), "marks")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, number, *_, runs, at in paragraphs_of(batch.column(1).to_pylist()):
                own = runs[at[:, None] + np.arange(RUNS)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(source)), pa.array(number.astype(np.int32)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * RUNS), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())],
                    names=["place", "paragraph", "runs"])

    held = with_mark(placed.select("place", "text"), holders, "place", words=words).where("maybe").select("place", "text")
    read = with_mark(held.mapInArrow(sets_of, "place long, paragraph int, runs binary"), wanted, "place", "paragraph", words=words)
    sets = stage(read.where("maybe").join(nodes, ["place", "paragraph"]).select("node", "runs"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, RUNS) for column in batch.columns[2:])
            good = linked(x, y, percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good))

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("runs").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("runs").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    def may_link(one: str, other: str) -> Column:
        return F.bit_count(F.col(f"{one}outline").bitwiseXOR(F.col(f"{other}outline"))) <= most_apart(percent)

    roots = list_components(lists, ["outline"], verified, may_link, rounds=STARS)
    rooted = classes.join(roots, "node", "left").where("component is not null or low <> high").select(
        F.coalesce("component", "node").alias("root"), *same, "first", "n", "low", "high")
    groups = rooted.groupBy("root").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    named = stage(rooted.select("root", *same).join(groups, "root").select(
        *same, F.col("first.key").alias("group_doc_id"), F.col("first.paragraph").alias("group_paragraph"),
        F.col("first.place").alias("group_place"), F.col("n").alias("group_size")), "groups")
    words = mark_words(named.count())
    found = with_mark(signed.select("place", key, "paragraph", "start", "end", *same),
                      stage(marks(named, *same, words=words), "marks"), *same, words=words).where("maybe")
    return found.join(named, same).withColumn(
        "kept", (F.col("place") == F.col("group_place")) & (F.col("paragraph") == F.col("group_paragraph"))).select(
            key, *ADDED)


def _maybe_met(lists: DataFrame) -> DataFrame:
    """The rows whose ``value`` several nodes have, with a few others by chance."""
    several = stage(shared_values(lists, "node"), "met")
    words = mark_words(several.count())
    near = with_mark(lists, stage(marks(several, "value", words=words), "marks"), "value", words=words)
    return near.where("maybe").drop("maybe")


def removals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end) of the spans that go: paragraphs not kept, overlapping or touching ones as one."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before) + 1, F.lit(True))
    numbered = found.where("not kept").withColumn("new", new.cast("int")).withColumn(
        "span", F.sum("new").over(Window.partitionBy(key).orderBy("start", "end")))
    return numbered.groupBy(key, "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")
