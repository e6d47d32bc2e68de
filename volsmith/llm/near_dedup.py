"""Near-duplicate documents: bottom-k sketches, inverted lists, union sketches, exact Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.llm.common import as_row, back_to_columns, mark_words, marks, text_of, with_mark
from volsmith.llm.linking import list_components, shared_values
from volsmith.llm.shingles import shingle_sets
from volsmith.session import ship_package, stage

#: Hash values that a sketch retains.
SKETCH = 128
PERCENT = 80
#: Chance that two documents just above the threshold share fewer sketch values than are asked for.
MISS = 1e-10
ADDED = ["n_shingles", "component_id", "kept"]


def least_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """Values that two full sketches of a linked pair share, but for a chance of ``miss``.

    The k smallest values of the union are a random sample of it, so those in both documents are
    at least binomial (sampling without replacement spreads less).
    """
    p, below, t = percent / 100, 0.0, 0
    while t <= k:
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            break
        t += 1
    return t


def _needed(percent: int, k: int) -> Column:
    """Shared sketch values that every link of a document has, by its set size ``n``.

    A set of at most ``k`` values is retained whole, and a partner's set, if larger than ``k``,
    lacks at most as many values as it is larger.
    """
    n = F.col("n")
    whole = F.ceil(n * percent / 100) - F.greatest(F.floor(n * 100 / percent) - k, F.lit(0))
    return F.when(n <= k, F.greatest(whole, F.lit(1))).otherwise(least_overlap(k, percent)).cast("int")


def signatures(docs: DataFrame, text: str, sketch: int, full: bool = False) -> DataFrame:
    """The rows of ``docs`` with (n, hi, lo, sketch) for the text; ``hi`` and ``lo`` name the shingle set.

    They are null where the set is empty. With ``full`` the last column is ``values``, the whole
    set as sorted unsigned 64-bit integers.
    """
    last = T.StructField("values", T.BinaryType()) if full else T.StructField("sketch", T.ArrayType(T.LongType()))
    own = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(c, T.LongType()) for c in ("n", "hi", "lo")] + [last])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, hi, lo, kept = [], [], [], []
                for values in shingle_sets(batch.column(len(own)).to_pylist()):
                    n.append(len(values))
                    name = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)
                    hi.append(int(name[0]) if len(values) else None)
                    lo.append(int(name[1]) if len(values) else None)
                    kept.append(values.tobytes() if full else values[:sketch].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                     pa.array(kept, pa.binary() if full else pa.list_(pa.int64()))], names=schema.names)

    ship_package(docs.sparkSession)
    return docs.select(*own, text_of(text).alias("text")).mapInArrow(sign, schema)


def linked(a: np.ndarray, b: np.ndarray, percent: int, k: int, need: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``percent``.

    Sets that are larger than a sketch are first compared by the ``k`` smallest values of their
    union, whose share in both estimates the similarity.
    """
    if k and max(len(a), len(b)) > k:
        union = np.union1d(a[:k], b[:k])[:k]
        both = np.intersect1d(a[:k], b[:k], assume_unique=True)
        if np.searchsorted(both, union[-1], "right") < min(need, len(union)):
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are linked, by their full sets; ``k`` 0 leaves the estimate out."""
    need = least_overlap(k, percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            good = [linked(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8"), percent, k, need)
                    for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def may_link(percent: int, n: str, at: str, other_n: str, other_at: str) -> Column:
    """Positional bound: of two sets whose first common value stands at these places, earlier ones are not shared."""
    most = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
    return (100 + percent) * most >= percent * (F.col(n) + F.col(other_n))


def prefix_lists(held: DataFrame, retained: Column, needed: Column) -> DataFrame:
    """(value, node, hi, lo, n, at): the inverted lists that a node has to be in.

    ``held`` has the values that several nodes share; the ``retained`` values of a node that are not
    in it are its own. In order of frequency, rarest first and its own before all, a node enters the
    lists of its first ``retained - needed + 1`` values; ``at`` is the place in that order. Two
    nodes with ``needed`` common values share one of these lists.
    """
    frequency = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = held.join(frequency, "value").groupBy("node", "hi", "lo", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    own = own.withColumn("u", (retained - F.size("shared")).cast("int")).withColumn("take", (retained - needed + 1 - F.col("u")).cast("int"))
    placed = own.where("take > 0").select(
        "node", "hi", "lo", "n", "u", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("i", "s"))
    return placed.select(F.col("s.value").alias("value"), "node", "hi", "lo", "n", (F.col("u") + F.col("i")).alias("at"))


def spread_values(sets: DataFrame) -> DataFrame:
    """One row (node, hi, lo, n, value) for each value of the full sets."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                own = [np.frombuffer(v.as_buffer(), "<i8") for v in batch.column(4)]
                source = pa.array(np.repeat(np.arange(len(own)), [len(v) for v in own]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(source) for c in batch.columns[:4]), pa.array(np.concatenate(own))],
                    names=["node", "hi", "lo", "n", "value"])

    return sets.select("node", "hi", "lo", "n", "values").mapInArrow(
        spread, "node long, hi long, lo long, n long, value long")


def near_links(rows: DataFrame, docs: DataFrame, text: str, percent: int, k: int) -> DataFrame:
    """Components (node, component) of the classes of equal sets, by links of at least ``percent``.

    ``rows`` are the staged signatures. Values of one class only are told from shared ones by two
    extremes of the class names, so a value's holders are never gathered. Shared values of the sketches
    form inverted lists, and a document that cannot share enough of them with any other is done.
    For the documents that are left, few in most corpora, the lists are drawn anew from their full sets,
    where the places of values bound every overlap sharply; pairs come from these lists.
    """
    values = rows.where("lo is not null").select("place", "n", "hi", "lo", F.explode("sketch").alias("value"))
    shared = stage(shared_values(values), "shared")
    words = mark_words(shared.count())
    near = with_mark(values, stage(marks(shared, "value", words=words), "marks"), "value", words=words).where("maybe")
    held = stage(near.join(shared, "value", "left_semi").groupBy("value", "hi", "lo").agg(
        F.min("place").alias("node"), F.max("n").alias("n")), "held")
    lists = prefix_lists(held, F.least(F.col("n"), F.lit(k)), _needed(percent, k))

    # The full sets of the documents in lists, by the names of their sets; copies are merged.
    met = lists.groupBy("value").agg(F.count("*").alias("met")).where("met > 1")
    nodes = stage(lists.join(met, "value").select("node", "hi", "lo", "n").distinct(), "nodes")
    words = mark_words(nodes.count())
    full = with_mark(signatures(docs, text, k, full=True).where("lo is not null"),
                     stage(marks(nodes, "hi", "lo", words=words), "marks"), "hi", "lo", words=words).where("maybe")
    sets = stage(full.select("hi", "lo", "values").dropDuplicates(["hi", "lo"]).join(nodes, ["hi", "lo"])
                 .select("node", "hi", "lo", "n", "values"), "sets")

    every = spread_values(sets)
    lists = stage(prefix_lists(every, F.col("n"), F.ceil(F.col("n") * percent / 100)), "lists")
    pairs_of = sets.select("node", "values")
    return list_components(
        lists.select("value", "node", "n", "at"), ["n", "at"], lambda pairs: verified_pairs(pairs, pairs_of, percent, k),
        lambda one, other: may_link(percent, f"{one}n", f"{one}at", f"{other}n", f"{other}at"),
        first=F.col("at") * 1000 / F.col("n"))


def near_verdicts(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
                  k: int = SKETCH) -> DataFrame:
    """``place``, ``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    A document's set holds its distinct five-word shingles (all its words where it has fewer), A-Z in
    lower case, as 64-bit hashes. Documents whose sets have a Jaccard similarity of at least
    ``percent`` hundredths are linked; ``component_id`` is the smallest key that links lead to. Of a
    component the row with that key stays, the first of them where rows repeat it. Null, empty and
    blank texts have an empty set, are linked with nothing and stay. A null key comes after all
    others. Equal sets are one class from the start, so a large group of copies costs one row. An empty table gives an empty result. ``place`` is the row's place in the stored table.
    """
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"), F.col(text).alias("body"))
    rows = stage(signatures(placed, "body", k), "signatures")
    bodies = docs.select(F.col(text).alias("body"))
    roots = near_links(rows, bodies, "body", percent, k)

    best = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "place")).alias("best")
    classes = stage(rows.where("lo is not null").groupBy("hi", "lo").agg(F.min("place").alias("node"), best), "classes")
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    whole = rooted.groupBy("root").agg(F.min("best").alias("whole"))
    named_classes = stage(rooted.join(whole, "root").select(
        "hi", "lo", F.col("whole.key").alias("low_key"), F.col("whole.place").alias("low_place")), "components")
    alone = F.col("low_place").isNull()
    return rows.select("place", "key", F.col("n").alias("n_shingles"), "hi", "lo").join(
        named_classes, ["hi", "lo"], "left").select(
            "place", "key", "n_shingles", F.when(alone, F.col("key")).otherwise(F.col("low_key")).alias("component_id"),
            (alone | (F.col("place") == F.col("low_place"))).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
               k: int = SKETCH) -> DataFrame:
    """Every row of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``, see ``near_verdicts``.

    A column of ``docs`` that has the name of an added one is replaced. ``docs`` has to be a
    stored table: rows are told apart by their places in it.
    """
    verdict = near_verdicts(docs, text, key, percent, k).drop("key")
    named = as_row(docs, F.monotonically_increasing_id().alias("place"))
    return back_to_columns(named.join(verdict, "place"), docs.columns, ADDED)


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
                        k: int = SKETCH) -> DataFrame:
    """The rows of ``docs`` that stay. Only rows that may have to go are shuffled with their texts."""
    dropped = stage(near_verdicts(docs, text, key, percent, k).where("not kept").select("place"), "dropped")
    words = mark_words(dropped.count())
    named = with_mark(as_row(docs, F.monotonically_increasing_id().alias("place")),
                      stage(marks(dropped, "place", words=words), "marks"), "place", words=words)
    stay = named.where("not maybe").unionByName(named.where("maybe").join(dropped, "place", "left_anti"))
    return back_to_columns(stay, docs.columns, [])
