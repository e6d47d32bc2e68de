"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.session import stage

#: Words of a mark table by default, and at most. With 64 bits each the largest table has 1,048,576
#: rows of two longs, about 32 MB as a broadcast relation, whatever the corpus holds.
MARK_WORDS, MOST_MARK_WORDS = 1 << 16, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z in lower case; letters beyond ASCII stay."""
    return F.translate(text, UPPER, LOWER)


def as_row(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` besides ``more``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def back_to_columns(df: DataFrame, names: Sequence[str], added: Sequence[str]) -> DataFrame:
    """The columns inside ``row`` and the ``added`` ones; an added one replaces its namesake."""
    own = [F.col(f"row.`{c}`").alias(c) for c in names if c not in set(added)]
    return df.select(*own, *added)


def mark_words(keys: int) -> int:
    """Words for about 16 bits a key, within bounds; beyond them chance hits become more frequent."""
    return min(MOST_MARK_WORDS, max(1 << 10, 1 << (max(keys, 1) // 4).bit_length()))


def _place(columns: Sequence[str], words: int) -> tuple[Column, Column]:
    code = F.xxhash64(*columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(code, 32), F.lit(64)).cast("int"))
    return F.pmod(code, F.lit(words)), bit


def marks(keys: DataFrame, *columns: str, words: int = MARK_WORDS) -> DataFrame:
    """A bit set of the hashed keys: at most ``words`` rows, so it may be broadcast."""
    word, bit = _place(columns, words)
    return keys.select(word.alias("mark_word"), bit.alias("bit")).groupBy("mark_word").agg(
        F.bit_or("bit").alias("mark_bits"))


def with_mark(df: DataFrame, marked: DataFrame, *columns: str, words: int = MARK_WORDS) -> DataFrame:
    """``df`` with ``maybe``: true for every marked key, and by chance for a few others.

    Large rows that cannot matter are told apart without a shuffle; what follows must give right
    results for the chance hits too.
    """
    word, bit = _place(columns, words)
    placed = df.withColumn("mark_word", word).withColumn("mark_bit", bit)
    joined = placed.join(F.broadcast(marked), "mark_word", "left")
    hit = F.coalesce(F.col("mark_bits").bitwiseAND(F.col("mark_bit")) != 0, F.lit(False))
    return joined.withColumn("maybe", hit).drop("mark_word", "mark_bit", "mark_bits")


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a stored table but for those at the staged places ``dropped`` (``place``, distinct).

    Only rows that a bit set of the places cannot clear are shuffled with their contents.
    """
    words = mark_words(dropped.count())
    named = with_mark(as_row(docs, F.monotonically_increasing_id().alias("place")),
                      stage(marks(dropped, "place", words=words), "marks"), "place", words=words)
    stay = named.where("not maybe").unionByName(named.where("maybe").join(dropped, "place", "left_anti"))
    return back_to_columns(stay, docs.columns, [])


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) for every linked node.

    ``component`` is the smallest node of the component. Each round lets every node point at its
    smallest neighbour, follows the pointers to their ends, and draws the links between those
    ends; all work is aggregation and joins over staged tables, nothing reaches the driver but
    whether links are left. A hub's links are merged in partial minima before the shuffle.
    """
    left = stage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
        "links")
    labels = None
    while not left.isEmpty():
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stage(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("top")), "points")
        moved = True
        while moved:
            onward = points.select(F.col("node").alias("top"), F.col("top").alias("beyond"))
            points = stage(
                points.join(onward, "top").select("node", F.col("beyond").alias("top"),
                                                  (F.col("beyond") != F.col("top")).alias("moved")), "points")
            moved = not points.where("moved").isEmpty()
            points = points.select("node", "top")
        labels = points if labels is None else stage(
            labels.withColumnRenamed("top", "mid").join(points.withColumnRenamed("node", "mid"), "mid", "left")
            .select("node", F.coalesce("top", "mid").alias("top")), "labels")
        at_a = points.select(F.col("node").alias("a"), F.col("top").alias("x"))
        at_b = points.select(F.col("node").alias("b"), F.col("top").alias("y"))
        left = stage(
            left.join(at_a, "a").join(at_b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        kind = left.schema["a"].dataType
        return left.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    lows = labels.groupBy("top").agg(F.min("node").alias("component"))
    return labels.join(lows, "top").select("node", "component")
