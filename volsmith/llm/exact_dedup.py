"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsmith.llm.common import as_row, back_to_columns, marks, text_of, with_mark
from volsmith.session import stage

#: Characters that the second level hashes.
PREFIX = 64
ADDED = ["keep_id", "group_size", "kept"]


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Rows with equal text form a group; the row with the largest key stays. Lengths that occur once
    are settled first; of the rest, (length, hash of the first ``prefix`` characters) pairs that
    occur once; the whole text is hashed (SHA-256) only for rows that both levels leave open. The
    open keys travel as a bit set of bounded size, so a text is shuffled only where the caller asks
    for it in the result and its group has several rows to be joined with.

    A null text counts as empty. A null key sorts below all others. Rows that repeat key and text
    form one group like any other copies; one of them stays, told apart by their place in the
    input, which therefore has to be a stored table. An empty table gives an empty result. A column of
    ``docs`` that has the name of an added one is replaced.
    """
    body = text_of(text)
    first = stage(docs.select(F.octet_length(body).alias("length"),
                              F.xxhash64(F.substring(body, 1, prefix)).alias("prefix")), "lengths")
    lengths = first.groupBy("length").count().where("count > 1")
    open_lengths = with_mark(first, marks(lengths, "length"), "length").where("maybe")
    pairs = open_lengths.groupBy("length", "prefix").count().where("count > 1")
    open_pairs = stage(marks(pairs, "length", "prefix"), "open")

    keyed = as_row(
        docs, F.col(key).alias("key"), body.alias("body"), F.monotonically_increasing_id().alias("place"),
        F.octet_length(body).alias("length"), F.xxhash64(F.substring(body, 1, prefix)).alias("prefix"))
    hashed = with_mark(keyed, open_pairs, "length", "prefix").withColumn(
        "full", F.when(F.col("maybe"), F.sha2("body", 256))).drop("body", "maybe")

    # A group of copies is summed up by key and then as a whole, each time in parts first.
    by_key = hashed.where("full is not null").groupBy("length", "prefix", "full", "key").agg(
        F.count("*").alias("same"), F.max("place").alias("place"))
    groups = stage(
        by_key.groupBy("length", "prefix", "full").agg(
            F.max("key").alias("keep_id"), F.max(F.struct("key", "same", "place")).alias("best"),
            F.sum("same").alias("group_size"))
        .where("group_size > 1")
        .select("full", "keep_id", "group_size", F.col("best.same").alias("same"),
                F.col("best.place").alias("best_place")), "groups")
    # Settled rows need no join and keep their place.
    joined = hashed.where("full is not null").join(groups, "full", "left").unionByName(
        hashed.where("full is null"), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    stays = F.col("key").eqNullSafe(F.col("keep_id")) & (
        (F.col("same") == 1) | (F.col("place") == F.col("best_place")))
    found = joined.select(
        "row", F.when(alone, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | stays).alias("kept"))
    return back_to_columns(found, docs.columns, ADDED)
