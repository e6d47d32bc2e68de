"""Regime discovery on daily features and the sweep over set-ups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsmith.operators.clean import select_features
from volsmith.operators.indices import dispersion_indices, silhouettes
from volsmith.operators.metrics import setup_means
from volsmith.operators.regimes import (
    KEYS, SCORES, Components, drop_incomplete, k_sweep, kmeans, pca_by_variance,
    stability_bootstrap, ward_labels, ward_stability, ward_tree,
)
from volsmith.operators.scaling import standardise
from volsmith.session import fit_side_by_side, stage


@dataclass
class RegimeRun:
    """Labelled features, the components used, one score row per k and rows left out."""

    labelled: DataFrame | None
    components: Components
    scores: DataFrame
    n_incomplete: int


def _indices(labelled: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> dict[str, dict[str, float]]:
    """The three indices of several labelings, which share all passes."""
    points = labelled.select(F.array(*[F.col(c) for c in columns]).alias("features"), *labels)
    found = dispersion_indices(points, labels)
    for row in silhouettes(points, labels).collect():
        found[row["labeling"]]["silhouette"] = row["silhouette"]
    return found


def regime_discovery(
    daily: DataFrame, method: str = "kmeans", share: float = 0.5, best_k: int = 0,
    stability: bool = True, runs: int = 5, n_init: int = 10, seed: int = 42,
    ks: Sequence[int] = (2, 3, 4, 5), order_by: str = "atm_iv",
) -> RegimeRun:
    """Standardise, reduce, cluster and score the daily features of one ticker.

    ``best_k`` fixes the number of clusters; 0 scores every k of ``ks`` and labels nothing. Days
    with a missing feature cannot be clustered: they are left out and counted.
    """
    spark = daily.sparkSession
    columns = select_features(daily, ("date", "ticker", "year", "regime"))
    # An older label in the input gives way to the new one.
    complete = stage(drop_incomplete(daily, columns).drop("regime"), "complete-days")
    n_incomplete = daily.count() - complete.count()
    scaled = stage(standardise(complete, columns), "scaled-days")
    components = pca_by_variance(scaled, columns, share)
    used = components.columns
    scored = components.scored
    if method not in ("kmeans", "ward"):
        raise ValueError("method is 'kmeans' or 'ward'")
    if method == "kmeans" and best_k == 0:
        sweep = k_sweep(scored, used, ks, n_init, seed, runs if stability else 0)
        return RegimeRun(None, components, sweep, n_incomplete)

    if method == "kmeans":
        fitted = kmeans(scored, used, best_k, n_init, seed, order_by)
        quality = _indices(fitted.labelled, used, ["regime"])["regime"]
        agreement = stability_bootstrap(scored, used, best_k, runs, n_init, seed).agg(
            F.avg("adjusted_rand")).first()[0] if stability else None
        scores = [_score(best_k, fitted.inertia, quality, agreement)]
        labels = complete.join(fitted.labelled.select(*KEYS, "regime"), list(KEYS))
        return RegimeRun(labels, components, spark.createDataFrame(scores, SCORES), n_incomplete)

    # One tree, cut at every k; the labelings share the passes of the indices.
    ks = [best_k] if best_k else list(ks)
    tree = ward_tree(scored, used, seed=seed)
    names = [f"ward{k}" for k in ks]
    cuts = {name: ward_labels(tree, k, order_by) for name, k in zip(names, ks, strict=True)}
    clustered = stage(tree.leaves.withColumns(cuts), "ward")
    found = _indices(clustered, used, names)
    agreed = ward_stability(scored, used, ks, runs, seed=seed, full=tree) if stability else []
    means = [sum(run[j] for run in agreed) / len(agreed) if agreed else None for j in range(len(ks))]
    scores = [_score(k, None, found[name], mean) for k, name, mean in zip(ks, names, means, strict=True)]
    labels = complete.join(clustered.select(*KEYS, F.col(names[0]).alias("regime")), list(KEYS)) if best_k else None
    return RegimeRun(labels, components, spark.createDataFrame(scores, SCORES), n_incomplete)


def _score(k: int, inertia: float | None, quality: dict[str, float], stability: float | None) -> tuple:
    return k, inertia, quality["silhouette"], quality["calinski_harabasz"], quality["davies_bouldin"], stability


def setup_sweep(
    daily: DataFrame, tickers: Iterable[str], methods: Sequence[str] = ("kmeans", "ward"),
    shares: Sequence[float] = (0.0, 0.3, 0.5, 0.7, 0.9), **settings,
) -> tuple[DataFrame, DataFrame]:
    """Score rows of every (ticker, method, share) and their means per set-up; set-ups run side by side."""
    spark = daily.sparkSession
    tasks = [(ticker, method, share) for ticker in tickers for method in methods for share in shares]

    def scored(task: tuple[str, str, float]) -> DataFrame:
        ticker, method, share = task
        run = regime_discovery(daily.where(F.col("ticker") == ticker), method, share, **settings)
        return run.scores.select(F.lit(ticker).alias("ticker"), F.lit(method).alias("method"),
                                 F.lit(float(share)).alias("pca"), "k", "silhouette", "stability")

    scores = reduce(DataFrame.unionByName, fit_side_by_side(spark, scored, tasks))
    lists = scores.groupBy("ticker", "method", "pca").agg(
        F.collect_list("silhouette").alias("silhouettes"),
        F.collect_list("stability").alias("stabilities"),
    )
    return scores, setup_means(lists)
