"""Exact quantiles that no task has to sort a whole group for.

A quantile sketch, merged across tasks, brackets the wanted rank; one further pass counts what lies
below the bracket and ranks only the distinct values inside it. The result is exact: the sketch only
decides where to look, and a bracket that misses the rank is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.session import stage

SKETCH_ACCURACY = 100_000


def _ranks(n: Column, q: float, kind: str) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank (both from 0) and the weight of the upper one."""
    position = (n - 1) * F.lit(q)
    if kind == "nearest":
        nearest = F.round(position).cast("bigint")
        return nearest, nearest, F.lit(0.0)
    if kind == "linear":
        low = F.floor(position)
        return low, F.ceil(position), position - low
    raise ValueError(f"unknown quantile kind {kind!r}")


def exact_quantiles(
    df: DataFrame, column: str, wanted: Mapping[str, tuple[float, str]], by: Iterable[str] = (),
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per group with the named quantiles of ``column``, NULLs ignored.

    ``wanted`` maps output names to ``(q, kind)``; kind ``nearest`` takes the value at rank
    round((n-1)q), kind ``linear`` interpolates between the neighbours of (n-1)q. Groups without a
    value get NULL.
    """
    by = list(by)
    names = list(wanted)
    value = F.col(column).cast("double")
    # Groups of up to ``accuracy`` rows are ranked whole: there the sketch's margin would be
    # narrower than the one or two ranks by which definitions of a quantile differ.
    margin = 4.0 / accuracy
    edges = [
        F.when(F.count(column) <= accuracy, F.array(F.min(value), F.max(value))).otherwise(
            F.percentile_approx(value, [max(q - margin, 0.0), min(q + margin, 1.0)], accuracy)
        ).alias(f"__edge{i}")
        for i, (q, _) in enumerate(wanted.values())
    ]
    brackets = stage(
        df.groupBy(*by).agg(F.count(column).alias("__n"), *edges), "quantile-brackets"
    )

    value = value.alias("__v")
    carried = ["__n", *[f"__edge{i}" for i in range(len(names))]]
    if by:
        same = reduce(
            lambda a, b: a & b, [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in by]
        )
        rows = df.alias("__l").join(brackets.alias("__r"), same).select(
            *[F.col(f"__r.{c}").alias(c) for c in by], value, *carried
        )
    else:
        only = brackets.first()
        bounds = {c: F.array(*[F.lit(v) for v in only[c]]) if only[c] else F.lit(None).cast(
            "array<double>") for c in carried[1:]}
        rows = df.select(value).withColumns({"__n": F.lit(only["__n"]), **bounds})
    inside = [F.col("__v").between(F.col(f"__edge{i}")[0], F.col(f"__edge{i}")[1])
              for i in range(len(names))]
    counts = (
        rows.withColumn("__key", F.when(reduce(or_, inside), F.col("__v")))
        .groupBy(*by, "__key")
        .agg(
            F.first("__n").alias("__n"),
            F.count("__v").alias("__m"),
            *[F.count(F.when(F.col("__v") < F.col(f"__edge{i}")[0], 1)).alias(f"__below{i}")
              for i in range(len(names))],
            *[F.count(F.when(inside[i], 1)).alias(f"__in{i}") for i in range(len(names))],
        )
    )
    upto = Window.partitionBy(*by).orderBy(F.col("__key").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    whole = Window.partitionBy(*by)
    ranked = counts.select(
        *by, "__key", "__n",
        *[F.sum(f"__below{i}").over(whole).alias(f"__base{i}") for i in range(len(names))],
        *[F.sum(f"__in{i}").over(upto).alias(f"__cum{i}") for i in range(len(names))],
        *[f"__in{i}" for i in range(len(names))],
    )

    picks: list[Column] = []
    results: list[Column] = []
    for i, (name, (q, kind)) in enumerate(wanted.items()):
        low, high, weight = _ranks(F.col("__n"), q, kind)
        base, cum = F.col(f"__base{i}"), F.col(f"__cum{i}")
        hit = F.col(f"__in{i}") > 0
        for side, rank in (("low", low), ("high", high)):
            picks.append(
                F.min(F.when(hit & (base <= rank) & (base + cum > rank), F.col("__key")))
                .alias(f"__{side}{i}")
            )
        picks.append(F.first(weight).alias(f"__w{i}"))
        a, b, w = F.col(f"__low{i}"), F.col(f"__high{i}"), F.col(f"__w{i}")
        missed = (F.col("__n") > 0) & (a.isNull() | b.isNull())
        results.append(
            F.when(missed, F.raise_error(F.lit(f"quantile bracket missed {name}")))
            .otherwise(a + (b - a) * w).cast("double").alias(name)
        )
    found = ranked.groupBy(*by).agg(F.first("__n").alias("__n"), *picks)
    return found.select(*by, *results)


def quantile_nearest(df: DataFrame, column: str, q: float, by: Iterable[str] = ()) -> DataFrame:
    """The value at rank round((n-1)q)."""
    return exact_quantiles(df, column, {"quantile": (q, "nearest")}, by)


def quantile_linear(df: DataFrame, column: str, q: float, by: Iterable[str] = ()) -> DataFrame:
    """Linear interpolation between ranks."""
    return exact_quantiles(df, column, {"quantile": (q, "linear")}, by)


def quantile_approx(
    df: DataFrame, column: str, q: float, by: Iterable[str] = (), accuracy: int = 10_000,
) -> DataFrame:
    """The sketch's own answer, rank error at most n/accuracy; one pass."""
    return df.groupBy(*by).agg(F.percentile_approx(column, q, accuracy).alias("quantile"))
