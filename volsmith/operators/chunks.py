"""Row windows over groups too large for one task.

A plain window sends each group whole to one task. Here a group is cut along its order into
chunks of about ``chunk_rows`` rows, and each chunk also receives the rows just before and after
it that a window frame may reach (its halo). Windows then run per chunk and halo rows are dropped.

Cuts fall between *cells*, the rows sharing one value of the leading order column (a date). Cell
sizes are counted first, which is a small aggregation, and decide the cuts exactly; nothing is
sampled, so a retried task sees the same cuts. A cell that is itself too large is divided by the
remaining order columns, with narrow margins at both ends that serve its neighbours as halos.

Rows learn their chunks from a table of the chunks' date ranges. It holds a few entries per chunk
and only for groups of several chunks, so it stays broadcastable where a table of cells would not,
and the rows are shuffled once, to their chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.config import CHUNK_ROWS
from volsmith.session import stage

WindowColumns = Callable[[WindowSpec], Mapping[str, Column]]
_SAMPLES_PER_CUT = 16
_MAX_CUTS = 1023


def _null_safe(left: str, right: str, columns: Iterable[str]) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns],
    )


def _count_cells(df: DataFrame, keys: Sequence[str], counted: Column | None, *more: Column) -> DataFrame:
    """Rows of each cell, ``__w`` of them counted by the reach backwards."""
    weight = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    return stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), weight.alias("__w"), *more), "cells")


def _margins(before: int, after: int, chunk_rows: int) -> tuple[int, int]:
    """Rows cut off at the end and at the start of a piece, for the chunk that follows and the one before it."""
    return tuple(2 * max(reach, chunk_rows // 64) if reach else 0 for reach in (before, after))


def _split_hot_cells(
    df: DataFrame, by: Sequence[str], order: Sequence[str], hot: DataFrame, chunk_rows: int,
    margins: tuple[int, int],
) -> DataFrame:
    """``df`` with the place of a row among the cuts of its hot cell: ``__piece`` counts the cuts a chunk
    may start at, about ``chunk_rows`` apart, ``__sub`` also those that set margins off. 0 elsewhere.

    Cuts are taken from a hashed sample of the remaining order columns, kept as a set of bounded
    size and staged, so they stay the same however often a task is retried.
    """
    lead, rest = order[0], list(order[1:])
    keys = [*by, lead]
    finer = F.struct(*[F.col(f"__d.{c}").alias(c) for c in rest])
    pieces = F.least(F.ceil(F.col("__n") / chunk_rows), F.lit(_MAX_CUTS + 1)).cast("int")
    gap = max(margins) / 8 or chunk_rows / _SAMPLES_PER_CUT
    chance = F.least(F.lit(1 / gap), _SAMPLES_PER_CUT * (_MAX_CUTS + 1) / F.col("__n"))
    unit = F.pmod(F.xxhash64(finer), F.lit(1 << 40)) / float(1 << 40)
    size = F.array_size("__sample")

    def values(places: Column) -> Column:
        inside = F.filter(places, lambda i: (i > 0) & (i < size))
        return F.array_sort(F.array_distinct(F.transform(inside, lambda i: F.get("__sample", i))))

    starts = F.transform(F.sequence(F.lit(0), pieces), lambda i: F.round(i * size / pieces).cast("int"))
    steps = [F.ceil(F.lit(margin) * size / F.col("__n")).cast("int") for margin in margins]
    around = F.flatten(F.transform("__starts", lambda i: F.array(
        *([i - steps[0]] if margins[0] else []), i, *([i + steps[1]] if margins[1] else []))))
    cuts = (
        df.alias("__d").join(hot.alias("__h"), _null_safe("__d", "__h", keys))
        .where(unit < chance)
        .groupBy(*[F.col(f"__h.{c}").alias(c) for c in keys])
        .agg(F.sort_array(F.collect_set(finer)).alias("__sample"), F.first("__n").alias("__n"))
        .withColumn("__starts", starts)
        .select(*keys, values(F.col("__starts")).alias("__borders"), values(around).alias("__cuts"))
    )
    staged = stage(cuts, "cell-cuts")

    def passed(name: str) -> Column:
        return F.coalesce(F.array_size(F.filter(F.col(f"__c.{name}"), lambda cut: cut < finer)), F.lit(0))

    return (
        df.alias("__d").join(staged.alias("__c"), _null_safe("__d", "__c", keys), "left")
        .select("__d.*", passed("__cuts").alias("__sub"), passed("__borders").alias("__piece"))
    )


def _with_cells(
    df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, chunk_rows: int,
    counted: Column | None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows, counted cells and the cell key; hot cells are divided where the order allows it.

    Whole cells are sent as halos, so a cell is hot as soon as it is much larger than the reach.
    """
    keys = [*by, order[0]]
    cells = _count_cells(df, keys, counted)
    if len(order) > 1:
        margins = _margins(before, after, chunk_rows)
        hot = cells.where(F.col("__n") > min(2 * chunk_rows, 3 * sum(margins) // 2 or 2 * chunk_rows))
        # Cells of groups that fit one chunk are never sent anywhere.
        large = cells.groupBy(*by).agg(F.sum("__n").alias("__n")).where(F.col("__n") > chunk_rows)
        hot = hot.alias("__c").join(large.alias("__g"), _null_safe("__c", "__g", by), "left_semi")
        if not hot.isEmpty():
            df = _split_hot_cells(df, by, order, hot, chunk_rows, margins)
            keys = [*keys, "__sub"]
            cells = _count_cells(df, keys, counted, F.min("__piece").alias("__piece"))
    return df, cells, keys


def _place_cells(
    cells: DataFrame, by: Sequence[str], keys: Sequence[str], before: int, after: int,
    chunk_rows: int,
) -> DataFrame:
    """Cells with the chunk they belong to and the range of chunks they are sent to.

    One row per cell: a group has as many as it has dates, so these windows stay small.
    """
    in_order = Window.partitionBy(*by).orderBy(*keys[len(by):])
    piece = [*keys[:len(by) + 1], *(["__piece"] if "__piece" in cells.columns else [])]
    placed = (
        cells.withColumn("__end", F.sum("__n").over(in_order.rowsBetween(
            Window.unboundedPreceding, 0)))
        .withColumn("__start", F.col("__end") - F.col("__n"))
        .withColumn("__before", F.sum("__w").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w"))
        .withColumn("__cut", F.floor(F.min("__start").over(Window.partitionBy(*piece)) / chunk_rows))
        .withColumn("__chunk", F.dense_rank().over(Window.partitionBy(*by).orderBy("__cut")))
    )
    # The next cell starts where this one ends, so the chunks that start within ``before`` counted rows
    # of this cell's end are the next cell's forward range; likewise backwards for ``after`` rows.
    forward = Window.partitionBy(*by).orderBy("__before").rangeBetween(0, max(before - 1, 0))
    backward = Window.partitionBy(*by).orderBy("__end").rangeBetween(-max(after - 1, 0), 0)
    reach = placed.withColumns({
        "__ahead": F.max("__chunk").over(forward), "__behind": F.min("__chunk").over(backward),
    })
    chunk = F.col("__chunk")
    last = F.coalesce(F.lead("__ahead").over(in_order), chunk) if before else chunk
    first = F.coalesce(F.lag("__behind").over(in_order), chunk) if after else chunk
    return reach.select(
        *keys, "__start", "__chunk", first.alias("__first"), last.alias("__last"),
        F.max("__chunk").over(Window.partitionBy(*by)).alias("__chunks"),
    )


def _at_most(x: Column, y: Column) -> Column:
    """x <= y with NULL before everything, as windows order it."""
    return F.coalesce(x <= y, x.isNull())


def _chunk_ranges(
    cells: DataFrame, by: Sequence[str], keys: Sequence[str], bucket: Column, before: int,
    after: int, chunk_rows: int,
) -> DataFrame:
    """One row per group, bucket of the order and chunk met there: the range of places the chunk
    receives, the range it owns and the rows before it. Groups of one chunk are left out."""
    place = _place(by, keys)
    mine = F.col("__at") == F.col("__chunk")
    # Most groups fit one chunk; their cells need no placing at all.
    large = cells.groupBy(*by).agg(F.sum("__n").alias("__n")).where(F.col("__n") > chunk_rows)
    of_large = cells.alias("__c").join(
        large.alias("__g"), _null_safe("__c", "__g", by), "left_semi"
    )
    sent = (
        _place_cells(of_large, by, keys, before, after, chunk_rows)
        .where(F.col("__chunks") > 1)
        .withColumn("__at", F.explode(F.sequence("__first", "__last")))
    )
    chunk = Window.partitionBy(*by, "__at")
    return (
        sent.withColumn("__from", F.min(F.when(mine, F.col("__start"))).over(chunk))
        .groupBy(*by, bucket.alias("__bucket"), "__at")
        .agg(
            # By the order's place and not by value, so that NULL dates count as the first ones.
            F.min_by(place, "__start").alias("__lo"), F.max_by(place, "__start").alias("__hi"),
            F.count(F.when(mine, 1)).alias("__mine"),
            F.min_by(place, F.when(mine, F.col("__start"))).alias("__own_lo"),
            F.max_by(place, F.when(mine, F.col("__start"))).alias("__own_hi"),
            F.first("__from").alias("__start"),
        )
    )


def _place(by: Sequence[str], keys: Sequence[str]) -> Column:
    """The part of the cell key that orders cells within a group."""
    rest = list(keys[len(by):])
    return F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)


def _spread(
    df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int,
    chunk_rows: int, counted: Column | None = None,
) -> DataFrame:
    """Rows once for each chunk that needs them: ``__at`` the chunk, ``__own`` whether the row
    belongs to it, ``__start`` the rows of the group before the chunk."""
    names = df.columns
    rows, cells, keys = _with_cells(df, by, order, before, after, chunk_rows, counted)
    lead_type = df.schema[order[0]].dataType
    dated = isinstance(lead_type, (T.DateType, T.TimestampType, T.TimestampNTZType))
    divided = len(keys) > len(by) + 1
    # Ranges are found by equality on the bucket and tested one by one within it. A week holds few chunks
    # however dense the dates are: chunks longer than a date are at least half a cell, else cells are divided.
    week = F.floor(F.unix_date(F.to_date(order[0])) / 7)
    bucket = F.col(order[0]) if divided else week if dated else F.lit(0)
    ranges = stage(
        _chunk_ranges(cells, by, keys, bucket, before, after, chunk_rows), "chunk-ranges"
    )
    place = F.col("__d.__place")
    met = (
        _null_safe("__d", "__p", [*by, "__bucket"])
        & _at_most(F.col("__p.__lo"), place) & _at_most(place, F.col("__p.__hi"))
    )
    own = (
        (F.col("__p.__mine") > 0)
        & _at_most(F.col("__p.__own_lo"), place) & _at_most(place, F.col("__p.__own_hi"))
    )
    placed = rows.withColumns({"__place": _place(by, keys), "__bucket": bucket})
    alone = F.col("__p.__at").isNull()
    return placed.alias("__d").join(ranges.alias("__p"), met, "left").select(
        *[F.col(f"__d.{c}").alias(c) for c in names],
        F.coalesce("__p.__at", F.lit(1)).alias("__at"),
        (alone | own).alias("__own"),
        F.coalesce("__p.__start", F.lit(0).cast("bigint")).alias("__start"),
    )


def in_chunks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0, after: int = 0, chunk_rows: int | None = CHUNK_ROWS, counted: Column | None = None,
) -> DataFrame:
    """``compute(rows, window)`` run on chunks of each group, on rows that reach ``before`` back and ``after`` ahead.

    ``compute`` may add window columns and drop rows between them; all its windows share one shuffle and
    one sort. With ``counted`` the reach backwards counts only the rows that meet this condition.
    """
    by, order = list(by), list(order)
    if chunk_rows is None:
        return compute(df, Window.partitionBy(*by).orderBy(*order))
    if chunk_rows < max(before, after, 1):
        raise ValueError("chunk_rows must be at least the reach of the window")
    spec = Window.partitionBy(*by, "__at").orderBy(*order)
    spread = _spread(df, by, order, before, after, chunk_rows, counted)
    return compute(spread, spec).where("__own").drop("__at", "__own", "__start")


def window_columns(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: WindowColumns,
    before: int = 0, after: int = 0, chunk_rows: int | None = CHUNK_ROWS,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``df`` plus window columns that look at most ``before`` rows back and ``after`` ahead.

    ``columns`` gets the ordered window and returns the new columns. ``keep`` may filter the result.
    ``chunk_rows=None`` runs a plain window: right where a group is bounded, as one row per ticker
    and day is.
    """
    result = in_chunks(df, by, order, lambda rows, w: rows.withColumns(dict(columns(w))), before, after, chunk_rows)
    return keep(result) if keep else result


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position",
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Row number from 0 within each group (W5): the rows before the chunk, then counted in it."""
    by, order = list(by), list(order)
    if chunk_rows is None:
        spec = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(spec).cast("bigint") - 1)
    spec = Window.partitionBy(*by, "__at").orderBy(*order)
    counted = F.col("__start") + F.row_number().over(spec) - 1
    return _spread(df, by, order, 0, 0, chunk_rows).withColumn(name, counted).select(
        *df.columns, name)
