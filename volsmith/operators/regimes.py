"""Regimes: k-means, variance-share PCA, Ward clusters and their stability."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.operators.chunks import positions
from volsmith.operators.indices import dispersion_indices, silhouettes
from volsmith.operators.lloyd import (
    Fit, Start, agreements, best_fits, fit_many, rand_index, with_labels,
)
from volsmith.operators.quantiles import quantile_nearest
from volsmith.session import fit_side_by_side, stage

KEYS = ("ticker", "date")
VECTOR = "__vector"
SCORES = ("k int, inertia double, silhouette double, calinski_harabasz double, "
          "davies_bouldin double, stability double")


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    packed = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(VECTOR, array_to_vector(packed))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every feature present; clustering has no meaning for the others."""
    return df.dropna(how="any", subset=list(columns))


def _relabel(raw: Column, order: Sequence[Any]) -> Column:
    """Cluster ids replaced by their place in ``order``."""
    pairs = [F.lit(v) for place, old in enumerate(order) for v in (old, place)]
    return F.create_map(*pairs)[raw].cast("int")


@dataclass
class Regimes:
    """Labelled rows, the centres behind them (in order of the labels) and the inertia."""

    labelled: DataFrame
    centres: np.ndarray
    inertia: float


def cluster_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Staged rows with every feature present, ``x`` (the features) and ``place``."""
    complete = drop_incomplete(df, columns)
    packed = F.array(*[F.col(c).cast("double") for c in columns])
    return stage(complete.withColumn("x", packed), "points").withColumn("place", F.monotonically_increasing_id())


def best_kmeans(points: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42) -> list[Fit]:
    """For each k the fit of least inertia among ``n_init`` seeded starts, all fitted together."""
    starts = [Start(k, seed + i) for k in ks for i in range(n_init)]
    fits = fit_many(points, starts)
    return best_fits(fits, [range(j * n_init, (j + 1) * n_init) for j in range(len(ks))])


def _ordered(fit: Fit, labelled: DataFrame, order_by: str) -> list[int]:
    """Cluster ids by ascending mean of ``order_by``; clusters without rows last."""
    means = {r["l"]: r["m"] for r in labelled.groupBy(F.col("labels")[0].alias("l")).agg(F.avg(order_by).alias("m")).collect()}
    return sorted(range(len(fit.centres)), key=lambda c: (c not in means, means.get(c, 0.0), c))


def kmeans(
    df: DataFrame, columns: Sequence[str], k: int, n_init: int = 10, seed: int = 42,
    order_by: str | None = None, label: str = "regime",
) -> Regimes:
    """Clusters of the (standardised) columns, numbered by ascending mean of ``order_by`` (M1)."""
    points = cluster_points(df, columns)
    fit = best_kmeans(points, [k], n_init, seed)[0]
    raw = stage(with_labels(points, [fit.centres]), "labelled")
    order = _ordered(fit, raw, order_by or columns[0])
    own = [c for c in df.columns if c != label]
    labelled = raw.select(*own, _relabel(F.col("labels")[0], order).alias(label))
    return Regimes(stage(labelled, "regimes"), fit.centres[order], fit.inertia)


def assign_to_centres(
    df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]],
    label: str = "regime",
) -> DataFrame:
    """The index of the nearest fixed centre, the first one on a tie (M1)."""
    distances = F.array(*[
        sum(((F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m)))
             for c, m in zip(columns, centre, strict=True)), F.lit(0.0))
        for centre in centres
    ])
    return df.withColumn(
        label, (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
    )


def k_sweep(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), n_init: int = 10,
    seed: int = 42, stability_runs: int = 0, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Inertia, the three indices and, with runs, bootstrap stability for each k (M2).

    All fits, of every k, start and bootstrap sample, advance together, one read an iteration; the
    labelings share one pass for silhouettes and two for the other indices.
    """
    spark, ks = df.sparkSession, list(ks)
    if stability_runs:
        points, pairs = _bootstrap_points(df, columns, stability_runs, seed, keys), stability_runs
    else:
        points, pairs = cluster_points(df, columns), 0
    starts = [Start(k, seed + i) for k in ks for i in range(n_init)]
    starts += [s for k in ks for run in range(pairs) for s in _pair_starts(k, run, n_init, seed)]
    fits = fit_many(points, starts)
    best = best_fits(fits, [range(at, at + n_init) for at in range(0, len(starts), n_init)])
    labelled = stage(with_labels(points, [f.centres for f in best]), "labelled-points")
    n = len(ks)
    compared = [(n + 2 * (j * pairs + run), n + 2 * (j * pairs + run) + 1, run) for j in range(n) for run in range(pairs)]
    agreed = agreements(labelled, compared) if pairs else []
    names = [f"k{k}" for k in ks]
    scored = labelled.select(F.col("x").alias("features"), *[F.col("labels")[j].alias(name) for j, name in enumerate(names)])
    shape = {r["labeling"]: r["silhouette"] for r in silhouettes(scored, names).collect()}
    spread = dispersion_indices(scored, names)
    rows = []
    for j, (k, name) in enumerate(zip(ks, names, strict=True)):
        stability = float(np.mean(agreed[j * pairs:(j + 1) * pairs])) if pairs else None
        rows.append((k, best[j].inertia, float(shape[name]), spread[name]["calinski_harabasz"],
                     spread[name]["davies_bouldin"], stability))
    return spark.createDataFrame(rows, SCORES)


@dataclass
class Components:
    """Rows with component columns, and the loadings behind them."""

    scored: DataFrame
    columns: list[str]
    loadings: DataFrame


def pca_by_variance(df: DataFrame, columns: Sequence[str], share: float) -> Components:
    """The fewest components whose cumulative variance exceeds ``share`` (M3); 0 is off, 1 keeps all.

    Columns must be standardised. Components are weighted sums of columns, so scoring stays a
    projection. The sign of a component is fixed: its largest loading is positive.
    """
    spark = df.sparkSession
    complete = drop_incomplete(df, columns)
    schema = "component int, feature string, loading double, ratio double"
    if share <= 0:
        return Components(complete, list(columns), spark.createDataFrame([], schema))
    width = len(columns)
    model = PCA(k=width, inputCol=VECTOR, outputCol="__pc").fit(_vectors(complete, columns))
    ratios = model.explainedVariance.toArray()
    kept = min(int(np.searchsorted(np.cumsum(ratios), share, side="right")) + 1, width) if share < 1 else width
    axes = model.pc.toArray()[:, :kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(kept)] < 0, -1.0, 1.0)
    names = [f"pc{i + 1}" for i in range(kept)]
    scored = complete.withColumns({
        name: sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, axes[:, i])), F.lit(0.0))
        for i, name in enumerate(names)
    })
    loadings = spark.createDataFrame(
        [(i + 1, c, float(axes[j, i]), float(ratios[i]))
         for i in range(kept) for j, c in enumerate(columns)], schema,
    )
    return Components(scored, names, loadings)


def top_loadings(loadings: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` features that weigh most in each component (T4)."""
    spec = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(spec)).where(F.col("rank") <= n)


def _ward_merges(centres: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Agglomeration of weighted centres, at each step the pair that adds least squared error.

    Works on the few hundred centres of a model, never on rows.
    """
    centre = {i: c for i, c in enumerate(np.asarray(centres, float))}
    size = {i: float(n) for i, n in enumerate(counts)}
    merges = []
    for step in range(len(centre) - 1):
        ids = np.array(sorted(centre))
        c = np.stack([centre[i] for i in ids])
        n = np.array([size[i] for i in ids])
        gap = ((c[:, None, :] - c[None, :, :]) ** 2).sum(-1)
        cost = 2.0 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * gap
        cost[np.tril_indices(len(ids))] = np.inf
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        a, b, new = int(ids[i]), int(ids[j]), len(centres) + step
        total = size[a] + size[b]
        centre[new] = (size[a] * centre.pop(a) + size[b] * centre.pop(b)) / total
        size[new] = total
        del size[a], size[b]
        merges.append((a, b, float(math.sqrt(cost[i, j])), int(total)))
    return merges


def _cut(merges: list[tuple[int, int, float, int]], leaves: int, k: int) -> list[int]:
    """The cluster of each leaf once ``k`` clusters are left."""
    parent = list(range(leaves + len(merges)))
    for step, (a, b, _, _) in enumerate(merges[: max(leaves - k, 0)]):
        parent[a] = parent[b] = leaves + step

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    roots = [root(i) for i in range(leaves)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return [order[r] for r in roots]


@dataclass
class WardTree:
    """Rows with the number of their leaf, and the merges of the leaves."""

    leaves: DataFrame
    n_leaves: int
    merges: list


@dataclass
class WardClusters:
    """Labelled rows and the merge table (left, right, height, size) of the leaves."""

    labelled: DataFrame
    merges: DataFrame


def ward_tree(df: DataFrame, columns: Sequence[str], micro: int = 256, seed: int = 42) -> WardTree:
    """The Ward tree over at most ``micro`` k-means centres, weighted by their rows (M9).

    The rows are condensed in the same way at every size; only centres and counts reach the driver.
    """
    vectors = _vectors(drop_incomplete(df, columns), columns).persist()
    try:
        model = KMeans(featuresCol=VECTOR, predictionCol="__leaf", k=micro, seed=seed, maxIter=20).fit(vectors)
        condensed = stage(model.transform(vectors).drop(VECTOR), "ward-leaves")
    finally:
        vectors.unpersist()
    sizes = {r["__leaf"]: r["count"] for r in condensed.groupBy("__leaf").count().collect()}
    used = sorted(sizes)
    merges = _ward_merges(np.array(model.clusterCenters())[used], np.array([sizes[i] for i in used]))
    return WardTree(condensed.withColumn("__leaf", _relabel(F.col("__leaf"), used)), len(used), merges)


def ward_exact_tree(df: DataFrame, columns: Sequence[str], most: int = 2048) -> WardTree:
    """Plain Ward over the distinct points, an error beyond ``most`` of them: for small tables only."""
    complete = drop_incomplete(df, columns)
    points = complete.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).limit(most + 1).collect()
    if len(points) > most:
        raise ValueError(f"more than {most} distinct points; use ward_tree")
    points = sorted(points, key=lambda r: tuple(r[c] for c in columns))
    centres = np.array([[float(r[c]) for c in columns] for r in points])
    leaves = df.sparkSession.createDataFrame(
        [tuple(r[c] for c in columns) + (i,) for i, r in enumerate(points)],
        complete.select(*columns, F.lit(0).alias("__leaf")).schema,
    )
    merges = _ward_merges(centres, np.array([r["__n"] for r in points]))
    return WardTree(stage(complete.join(leaves, list(columns)), "ward-leaves"), len(points), merges)


def ward_labels(tree: WardTree, k: int, order_by: str) -> Column:
    """Label of a row of ``tree.leaves`` in the tree cut at ``k``, by ascending mean of ``order_by``."""
    clusters = _cut(tree.merges, tree.n_leaves, k)
    raw = F.array(*[F.lit(c) for c in clusters])[F.col("__leaf")]
    means = tree.leaves.groupBy(raw.alias("__raw")).agg(F.avg(order_by).alias("m")).orderBy("m", "__raw").collect()
    return _relabel(raw, [r["__raw"] for r in means])


def ward_cut(tree: WardTree, k: int, order_by: str, label: str = "regime") -> WardClusters:
    """The tree cut at ``k`` clusters, numbered by ascending mean of ``order_by``."""
    own = [c for c in tree.leaves.columns if c not in ("__leaf", label)]
    table = tree.leaves.sparkSession.createDataFrame(
        [(step, int(i), int(j), float(h), int(n)) for step, (i, j, h, n) in enumerate(tree.merges)],
        "step int, left int, right int, height double, size bigint",
    )
    return WardClusters(tree.leaves.select(*own, ward_labels(tree, k, order_by).alias(label)), table)


def ward_clusters(
    df: DataFrame, columns: Sequence[str], k: int, micro: int = 256, seed: int = 42,
    order_by: str | None = None, label: str = "regime",
) -> WardClusters:
    """Ward clusters cut at ``k`` over condensed rows, see ``ward_tree`` (M9)."""
    return ward_cut(ward_tree(df, columns, micro, seed), k, order_by or columns[0], label)


def truncated_tree(merges: DataFrame, leaves: int = 12) -> DataFrame:
    """The last ``leaves - 1`` merges, those a truncated dendrogram shows."""
    return merges.orderBy(F.desc("step")).limit(leaves - 1)


def sample_exactly(df: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """A seeded sample of ``floor(n * share)`` rows without replacement.

    Rows are ranked by a hash of their keys and cut at an exact quantile, so no task sees them all.
    The keys must be unique; where they are not, rows with equal keys make the size inexact and
    the sample is refused.
    """
    hashed = df.withColumn(
        "__u", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)).cast("double")
    )
    n = hashed.count()
    size = int(n * share)
    if size < 1:
        return df.limit(0)
    cut = quantile_nearest(hashed, "__u", (size - 1) / max(n - 1, 1)).first()[0]
    drawn = hashed.where(F.col("__u") <= cut)
    if drawn.count() != size:
        raise ValueError("the keys of a sampled table must be unique")
    return drawn.drop("__u")


def _drawn(complete: DataFrame, runs: int, share: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``weights``: for each run 1 if the row is in its sample, else 0."""
    parts = [sample_exactly(complete, keys, share, seed + run).select(*keys, F.lit(run).alias("run")) for run in range(runs)]
    marks = [F.max(F.when(F.col("run") == run, 1.0).otherwise(0.0)) for run in range(runs)]
    drawn = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.array(*marks).alias("weights"))
    nothing = F.array(*[F.lit(0.0)] * runs)
    return complete.select(*keys).join(drawn, list(keys), "left").withColumn("weights", F.coalesce("weights", nothing))


def stability_subsample(
    df: DataFrame, columns: Sequence[str], k: int, runs: int = 5, share: float = 0.8,
    method: str = "kmeans", n_init: int = 10, seed: int = 42, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Agreement of the labels of all rows with those of a refit on a sample, run by run (M8).

    Samples are weights of 0 and 1, so the k-means fits of all runs advance together.
    """
    spark = df.sparkSession
    if method == "ward":
        found = ward_stability(df, columns, [k], runs, share, seed=seed, keys=keys)
        return spark.createDataFrame([(run, own[0]) for run, own in enumerate(found)], "run int, adjusted_rand double")
    if method != "kmeans":
        raise ValueError("method is 'kmeans' or 'ward'")
    complete = stage(drop_incomplete(df, columns), "complete")
    weighted = complete.join(_drawn(complete, runs, share, seed, keys), list(keys))
    points = cluster_points(weighted, columns)
    starts = [Start(k, seed + i) for i in range(n_init)]
    starts += [Start(k, seed + run + i, run) for run in range(runs) for i in range(n_init)]
    fits = best_fits(fit_many(points, starts), [range(j * n_init, (j + 1) * n_init) for j in range(runs + 1)])
    labelled = with_labels(points, [f.centres for f in fits])
    found = agreements(labelled, [(0, 1 + run, run) for run in range(runs)])
    return spark.createDataFrame(list(enumerate(found)), "run int, adjusted_rand double")


def ward_stability(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int], runs: int = 5, share: float = 0.8, micro: int = 256,
    seed: int = 42, keys: Sequence[str] = KEYS, full: WardTree | None = None,
) -> list[list[float]]:
    """For each run the agreement, for every k, of the Ward clusters of all rows with those of a sample.

    One tree a run serves all k: rows are counted by their leaves in both trees, and the trees are cut in
    the counts. The runs' trees are built side by side.
    """
    spark = df.sparkSession
    complete = stage(drop_incomplete(df, columns), "complete")
    full = full or ward_tree(complete, columns, micro, seed)
    leaves = full.leaves.select(*keys, F.col("__leaf").alias("__full"))

    def agree(run: int) -> list[float]:
        part = ward_tree(sample_exactly(complete, keys, share, seed + run), columns, micro, seed + run)
        counts = part.leaves.join(leaves, list(keys)).groupBy("__full", "__leaf").count().collect()
        found = []
        for k in ks:
            a, b = _cut(full.merges, full.n_leaves, k), _cut(part.merges, part.n_leaves, k)
            cells: dict[tuple[int, int], float] = {}
            for row in counts:
                cell = a[row["__full"]], b[row["__leaf"]]
                cells[cell] = cells.get(cell, 0.0) + row["count"]
            found.append(rand_index([(*cell, n) for cell, n in cells.items()]))
        return found

    return fit_side_by_side(spark, agree, range(runs))


def bootstrap_index(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a number ``__i`` from 0 without gaps, staged: every bootstrap sample draws from it."""
    indexed = positions(df.withColumn("__all", F.lit(0)), ["__all"], [keys[-1], *keys[:-1]], "__i")
    return stage(indexed.drop("__all"), "indexed")


def bootstrap_counts(indexed: DataFrame, seed: int) -> DataFrame:
    """Rows drawn with replacement, as many draws as rows: each drawn row once, with its count."""
    n = indexed.count()
    draws = (
        indexed.sparkSession.range(n)
        .select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("__i"))
        .groupBy("__i").agg(F.count(F.lit(1)).cast("double").alias("__weight"))
    )
    return indexed.join(draws, "__i").drop("__i")


def _bootstrap_points(df: DataFrame, columns: Sequence[str], runs: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """``cluster_points`` with ``weights``: how often each run's sample, as large as the table, draws the row."""
    indexed = bootstrap_index(drop_incomplete(df, columns), keys)
    n = indexed.count()
    draws = [F.pmod(F.xxhash64("id", F.lit(seed + run)), F.lit(n)) for run in range(runs)]
    drawn = indexed.sparkSession.range(n).select(F.posexplode(F.array(*draws)).alias("run", "__i")).groupBy("__i").agg(
        F.array(*[F.sum(F.when(F.col("run") == run, 1.0).otherwise(0.0)) for run in range(runs)]).alias("weights"))
    nothing = F.array(*[F.lit(0.0)] * runs)
    weighted = indexed.join(drawn, "__i", "left").withColumn("weights", F.coalesce("weights", nothing)).drop("__i")
    return cluster_points(weighted, columns)


def _pair_starts(k: int, run: int, n_init: int, seed: int) -> list[Start]:
    """The starts of two independent fits on one sample."""
    return [Start(k, seed + 1000 * run + first + i, run) for first in (1, 501) for i in range(n_init)]


def stability_bootstrap(
    df: DataFrame, columns: Sequence[str], k: int, runs: int = 5, n_init: int = 10, seed: int = 42,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Agreement of two independently started k-means fits on one bootstrap sample.

    Repeated rows are weights, so a sample is never larger than the data, and the fits of all runs advance
    together.
    """
    points = _bootstrap_points(df, columns, runs, seed, keys)
    starts = [s for run in range(runs) for s in _pair_starts(k, run, n_init, seed)]
    fits = best_fits(fit_many(points, starts), [range(j * n_init, (j + 1) * n_init) for j in range(2 * runs)])
    labelled = with_labels(points, [f.centres for f in fits])
    found = agreements(labelled, [(2 * run, 2 * run + 1, run) for run in range(runs)])
    return df.sparkSession.createDataFrame(list(enumerate(found)), "run int, adjusted_rand double")
