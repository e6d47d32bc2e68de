"""Many k-means fits at once: every start, k and weighting advances in the same pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.session import ship_package

#: Rows that starting centres are drawn from, the same for every fit; all rows take part in the fits.
SEED_ROWS = 4096
#: A fit ends once the squared moves of its centres sum to less than this share of the mean variance.
TOLERANCE, MOST_PASSES = 1e-4, 300
#: Distances that a task holds at a time.
CELLS = 4_000_000


@dataclass(frozen=True)
class Start:
    """One fit: number of clusters, seed, and which entry of ``weights`` counts a row (None: each once)."""

    k: int
    seed: int
    weight: int | None = None


@dataclass
class Fit:
    """Centres of a finished fit, its inertia, and whether it stopped by itself."""

    centres: np.ndarray
    inertia: float
    settled: bool


def _sample(points: DataFrame, order: str, weighted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    columns = ["x", *(["weights"] if weighted else [])]
    drawn = points.orderBy(F.xxhash64(order), order).select(*columns).limit(SEED_ROWS).collect()
    return np.array([r["x"] for r in drawn], float), np.array([r["weights"] for r in drawn], float) if weighted else None


def _first_centres(x: np.ndarray, weight: np.ndarray, start: Start) -> np.ndarray:
    """Centres drawn one by one, with chances by weight and squared distance to those before."""
    random = np.random.default_rng(start.seed)
    chosen = [random.choice(len(x), p=weight / weight.sum())]
    for _ in range(start.k - 1):
        gap = np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0) * weight
        chosen.append(random.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else chosen[-1])
    return x[chosen]


def _batches(batches: Iterator[pa.RecordBatch], dims: int, columns: int, weighted: bool) -> Iterator[tuple]:
    """(x, weights) of a bounded number of rows."""
    step = max(1, CELLS // max(columns, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            yield x, batch.column(1).flatten().to_numpy().reshape(len(x), -1) if weighted else None, batch


def nearest(x: np.ndarray, centres: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set of centres the nearest one of every row and its squared distance; one product for all."""
    every = np.concatenate(centres)
    cross = (every * every).sum(1)[None, :] - 2.0 * x @ every.T
    own, at, found = (x * x).sum(1), 0, []
    for c in centres:
        part = cross[:, at:at + len(c)]
        label = part.argmin(1)
        found.append((label, np.maximum(part[np.arange(len(x)), label] + own, 0.0)))
        at += len(c)
    return found


def fit_many(points: DataFrame, starts: Sequence[Start], order: str = "place", most: int = MOST_PASSES) -> list[Fit]:
    """The fits of all ``starts`` over the stored ``points`` (``x``, ``order`` and, if used, ``weights``).

    Each pass gives every unfinished fit its labels and sums in one aggregation, of which the driver
    gets one row for each cluster of each fit. A cluster without rows keeps its centre. Starting centres
    come from ``SEED_ROWS`` rows in order of a hash. No rows: an error.
    """
    spark = points.sparkSession
    ship_package(spark)
    weighted = any(s.weight is not None for s in starts)
    sample, sample_weights = _sample(points, order, weighted)
    if not len(sample):
        raise ValueError("no rows to cluster")
    dims = sample.shape[1]
    even = np.ones(len(sample))
    weight_of = [even if s.weight is None else sample_weights[:, s.weight] for s in starts]
    centres = [_first_centres(sample, w if w.sum() > 0 else even, s) for s, w in zip(starts, weight_of, strict=True)]
    bound = TOLERANCE * max(float(sample.var(0).mean()), 1e-300)
    read = points.select("x", *(["weights"] if weighted else []))
    schema = T.StructType([T.StructField("fit", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("n", T.DoubleType()), T.StructField("cost", T.DoubleType()),
                           *(T.StructField(f"s{i}", T.DoubleType()) for i in range(dims))])
    fits: list[Fit | None] = [None] * len(starts)
    last: set[int] = set()  # fits whose centres have settled: their inertia is still to be summed
    for turn in range(most + 1):
        open_fits = [i for i, f in enumerate(fits) if f is None]
        if not open_fits:
            break
        sent = spark.sparkContext.broadcast([centres[i] for i in open_fits])
        entries = [starts[i].weight for i in open_fits]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sums = [np.zeros((len(c), 2 + dims)) for c in own]
            for x, weights, _ in _batches(batches, dims, sum(map(len, own)), weighted):
                for fit, (label, gap) in enumerate(nearest(x, own)):
                    w = np.ones(len(x)) if entries[fit] is None else weights[:, entries[fit]]
                    k = len(own[fit])
                    sums[fit][:, 0] += np.bincount(label, w, k)
                    sums[fit][:, 1] += np.bincount(label, w * gap, k)
                    for d in range(dims):
                        sums[fit][:, 2 + d] += np.bincount(label, w * x[:, d], k)
            table = np.concatenate(sums)
            names = [(f, c) for f, s in enumerate(sums) for c in range(len(s))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], pa.int32()), pa.array([n[1] for n in names], pa.int32()),
                 *(pa.array(column) for column in table.T)], names=schema.names)

        added = read.mapInArrow(step, schema).groupBy("fit", "cluster").agg(
            *[F.sum(c).alias(c) for c in schema.names[2:]]).collect()
        cost = np.zeros(len(open_fits))
        moved = [c.copy() for c in sent.value]
        for row in added:
            cost[row["fit"]] += row["cost"]
            if row["n"] > 0:
                moved[row["fit"]][row["cluster"]] = [row[f"s{d}"] / row["n"] for d in range(dims)]
        for place, i in enumerate(open_fits):
            if i in last or turn == most:
                fits[i] = Fit(centres[i], float(cost[place]), i in last)
                continue
            shift = float(((moved[place] - centres[i]) ** 2).sum())
            centres[i] = moved[place]
            if shift <= bound:
                last.add(i)
        sent.unpersist()
    return fits


def best_fits(fits: Sequence[Fit], groups: Sequence[Sequence[int]]) -> list[Fit]:
    """Of each group of fits the one of least inertia, the first of equals."""
    return [min((fits[i] for i in group), key=lambda f: f.inertia) for group in groups]


def with_labels(points: DataFrame, models: Sequence[np.ndarray], name: str = "labels") -> DataFrame:
    """``points`` with an array of labels, one for each set of centres."""
    sent = points.sparkSession.sparkContext.broadcast(list(models))
    dims = models[0].shape[1]
    at = points.columns.index("x")
    schema = T.StructType([*points.schema, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CELLS // sum(map(len, sent.value)))
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                x = batch.column(at).flatten().to_numpy().reshape(-1, dims)
                found = np.column_stack([own for own, _ in nearest(x, sent.value)]).astype(np.int32)
                ends = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))],
                                                 names=schema.names)

    return points.mapInArrow(label, schema)


def rand_index(cells: Sequence[tuple[int, int, float]]) -> float:
    """Adjusted Rand index of two labelings from the counts of their pairs of labels (few numbers)."""
    rows: dict[int, float] = {}
    columns: dict[int, float] = {}
    for a, b, n in cells:
        rows[a] = rows.get(a, 0.0) + n
        columns[b] = columns.get(b, 0.0) + n
    pairs = lambda n: n * (n - 1) / 2
    joint, left, right = sum(pairs(n) for *_, n in cells), sum(map(pairs, rows.values())), sum(map(pairs, columns.values()))
    every = pairs(sum(rows.values()))
    expected, limit = (left * right / every if every else None), (left + right) / 2
    return 1.0 if expected is None or limit == expected else (joint - expected) / (limit - expected)


def agreements(labelled: DataFrame, pairs: Sequence[tuple[int, int, int | None]]) -> list[float]:
    """Adjusted Rand index of each (labeling, other labeling, entry of ``weights`` or None), all in one aggregation."""
    each = [F.struct(F.lit(i).alias("pair"), F.col("labels")[a].alias("a"), F.col("labels")[b].alias("b"),
                     (F.lit(1.0) if w is None else F.col("weights")[w]).alias("n")) for i, (a, b, w) in enumerate(pairs)]
    long = labelled.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    cells: list[list] = [[] for _ in pairs]
    for row in long.groupBy("pair", "a", "b").agg(F.sum("n").alias("n")).where("n > 0").collect():
        cells[row["pair"]].append((row["a"], row["b"], row["n"]))
    return [rand_index(own) for own in cells]
