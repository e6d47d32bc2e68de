"""Augmented Dickey-Fuller test by ticker.

Spark lags the series and sums the cross products of the regressors; what is solved in Python is one
small system per ticker and lag.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsmith.config import CHUNK_ROWS
from volsmith.operators.chunks import positions, window_columns
from volsmith.session import ship_package, stage

# Response surface of the p-value with a constant and one series (MacKinnon 1994).
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_STAR = -1.61
SMALL_P = [2.1659, 1.4412, 0.038269]
LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]

RESULT = "adf_stat double, p_value double, used_lag int, n_obs bigint, aic double"


def mackinnon_p(tau: float) -> float:
    """Approximate p-value of a test statistic."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = SMALL_P if tau <= TAU_STAR else LARGE_P
    z = sum(c * tau**power for power, c in enumerate(terms))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def _cross_products(by: str, width: int):
    """Per batch, the summed outer products of ``z`` for each (ticker, bucket)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (key, bucket), rows in batch.groupby([by, "bucket"], sort=False):
                z = np.stack(rows["z"].to_numpy())
                out.append((key, bucket, len(z), (z.T @ z).reshape(width * width)))
            yield pd.DataFrame(out, columns=[by, "bucket", "n", "gram"])

    return run


def _fit(gram: np.ndarray, n: int, lags: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Residual sum of squares, AIC, coefficients and inverse for the first ``lags`` lags."""
    used = np.arange(lags + 2)
    xx, xy, yy = gram[np.ix_(used, used)], gram[used, -1], gram[-1, -1]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    ssr = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 1e-300)
    aic = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0) + 2.0 * len(used)
    return ssr, aic, beta, inverse


def _solve(by: str, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = {
            bucket: (int(part["n"].sum()),
                     np.sum(np.stack(part["gram"].to_numpy()), axis=0).reshape(width, width))
            for bucket, part in rows.groupby("bucket")
        }
        n, gram = grams.get(0, (0, np.zeros((width, width))))
        early = sorted(b for b in grams if b > 0)
        max_lag = max((b - 1 for b in early), default=0)
        result = (None, None, None, n, None)
        flat = n > max_lag + 2 and all(g[-1, -1] == 0 for b, (_, g) in grams.items() if b >= 0)
        if flat:
            n += sum(grams[b][0] for b in early)
            result = (None, None, 0, n, None)
        elif n > max_lag + 2:
            lag = min(range(max_lag + 1), key=lambda p: (_fit(gram, n, p)[1], p))
            # Fewer lags free earlier rows: those are added before the chosen fit.
            for bucket in early:
                if bucket >= lag + 2:
                    n, gram = n + grams[bucket][0], gram + grams[bucket][1]
            ssr, aic, beta, inverse = _fit(gram, n, lag)
            error = math.sqrt(ssr / (n - lag - 2) * inverse[1, 1])
            if error > 0:
                tau = float(beta[1] / error)
                result = (tau, mackinnon_p(tau), lag, n, aic)
        columns = [by, "adf_stat", "p_value", "used_lag", "n_obs", "aic", "flat"]
        return pd.DataFrame([(rows[by].iloc[0], *result, flat)], columns=columns).astype(
            {"used_lag": "Int32", "n_obs": "Int64"}
        )

    return run


def adf(
    df: DataFrame, column: str, by: str = "ticker", order: str = "date",
    max_lag: int | None = None, chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Statistic, p-value and chosen lag per ticker, with a constant.

    The lag is the one of least AIC up to ``max_lag``, by default ceil(12 (n/100)^(1/4)).
    Missing values are dropped before lagging. A series too short gives NULLs, one that never changes NaN: its
    statistic is zero by zero. A long series is cut into
    chunks, each with the rows before it that the longest lag reaches, and the chunks' sums of products are
    added up.
    """
    ship_package(df.sparkSession)
    series = df.where(F.col(column).isNotNull()).select(
        by, order, F.col(column).cast("double").alias("y")
    )
    sizes = stage(series.groupBy(by).agg(F.count(F.lit(1)).alias("__n")), "series-sizes")
    n = F.col("__n")
    limit = F.greatest(F.floor(n / 2) - 2, F.lit(0))
    wanted = F.ceil(12 * F.pow(n / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    lags = F.least(wanted, limit).cast("int")
    longest = int(sizes.agg(F.max(lags)).first()[0] or 0) if max_lag is None else max_lag
    width = longest + 3
    placed = positions(series, [by], [order], "r", chunk_rows).withColumn("r", (F.col("r") + 1).cast("int"))
    shifted = window_columns(
        placed, [by], [order], lambda w: {f"y{i}": F.lag("y", i).over(w) for i in range(1, longest + 2)},
        before=longest + 1, chunk_rows=chunk_rows,
    ).join(sizes, by)
    values = ["y", *(f"y{i}" for i in range(1, longest + 2))]
    step, *lagged = (F.coalesce(F.col(a) - F.col(b), F.lit(0.0)) for a, b in zip(values, values[1:]))
    regressors = shifted.select(
        by, "r", lags.alias("lags"), F.array(F.lit(1.0), F.coalesce("y1", F.lit(0.0)), *lagged, step).alias("z")
    )
    # Bucket 0 holds the rows every lag can use, 2 and up the early rows one by one. The first row
    # has no predecessor; its bucket only keeps a one-row ticker in the result.
    bucket = (
        F.when(F.col("r") == 1, F.lit(-1))
        .when(F.col("r") >= F.col("lags") + 2, F.lit(0)).otherwise(F.col("r"))
    )
    key_type = dict(series.dtypes)[by]
    partial = regressors.select(by, bucket.alias("bucket"), "z").mapInPandas(
        _cross_products(by, width), f"{by} {key_type}, bucket int, n bigint, gram array<double>"
    )
    solved = partial.groupBy(by).applyInPandas(_solve(by, width), f"{by} {key_type}, {RESULT}, flat boolean")
    # Set here because a NaN from pandas arrives as NULL.
    return solved.withColumns({
        c: F.when(F.col("flat"), F.lit(float("nan"))).otherwise(F.col(c)) for c in ("adf_stat", "p_value", "aic")
    }).drop("flat")
