"""Linear models of many groups at once, from sums of cross products.

One pass over the rows adds up the products of all features and targets for each group and fold. Every
model of every group then comes from these sums: a fold is left out by subtraction, several targets share
one matrix, and a squared error follows without looking at a row. Only predictions read the rows again.

Rows have the group's key columns, a fold number, ``features`` and ``targets`` (arrays of doubles, of one
length within a group) and ``order``, a column that tells a group's rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsmith.session import ship_package, stage

#: Rows of a group that one task adds up, and rows of the product matrix that travel together.
BLOCK_ROWS, BAND = 8192, 64
#: Share of the largest variance below which a direction counts as none.
RANK = 1e-10


@dataclass(frozen=True)
class Linear:
    """A penalised linear model: ``penalty`` times (``lasso`` of absolute values, the rest of squares).

    Features and target count in units of their deviations, so a penalty means the same everywhere.
    """

    penalty: float = 0.0
    lasso: float = 0.0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy().reshape(len(column), -1)


def in_blocks(rows: DataFrame, by: Sequence[str], order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``block``: a group of many rows is dealt to several tasks."""
    sizes = stage(rows.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).alias("blocks")), "group-sizes")
    return rows.join(sizes, list(by)).withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks"))).drop("blocks")


def cross_products(rows: DataFrame, by: Sequence[str], order: str = "end_date") -> DataFrame:
    """Staged sums for each group and fold, in bands: by, fold, width, outputs, band, sums.

    With z = (1, features, targets), the sums are those of all z z'. ``rows`` has a ``block``; each block
    is added up by itself and the blocks of a band then meet, so no task gets a whole large group.
    """
    ship_package(rows.sparkSession)
    keys = [rows.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("fold", T.IntegerType()), T.StructField("width", T.IntegerType()),
                           T.StructField("outputs", T.IntegerType()), T.StructField("band", T.IntegerType()),
                           T.StructField("block", T.LongType()), T.StructField("sums", T.BinaryType())])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x, y = _matrix(table.column("features")), _matrix(table.column("targets"))
        z = np.column_stack([np.ones(len(x)), x, y])
        sums = z.T @ z
        bands = [sums[at:at + BAND].tobytes() for at in range(0, len(sums), BAND)]
        same = [pa.array([table.column(c)[0].as_py()] * len(bands), table.schema.field(c).type) for c in by]
        fold, block = table.column("fold")[0].as_py(), table.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [*same, *(pa.array([v] * len(bands), pa.int32()) for v in (fold, x.shape[1], y.shape[1])),
             pa.array(range(len(bands)), pa.int32()), pa.array([block] * len(bands), pa.int64()), pa.array(bands, pa.binary())],
            names=schema.names)

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        first = table.slice(0, 1)
        return first.set_column(schema.names.index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    narrow = rows.select(*by, "fold", "block", order, "features", "targets")
    partial = narrow.groupBy(*by, "fold", "block").applyInArrow(local, schema)
    return stage(partial.groupBy(*by, "fold", "band").applyInArrow(together, schema).drop("block"), "cross-products")


def _by_fold(table: pa.Table) -> tuple[int, dict[int, np.ndarray]]:
    """Feature count and the whole matrix of each fold of one group."""
    width, outputs = table.column("width")[0].as_py(), table.column("outputs")[0].as_py()
    size, bands = 1 + width + outputs, {}
    for fold, band, sums in zip(*(table.column(c).to_pylist() for c in ("fold", "band", "sums")), strict=True):
        bands.setdefault(fold, {})[band] = np.frombuffer(sums)
    return width, {f: np.concatenate([own[b] for b in sorted(own)]).reshape(size, size) for f, own in sorted(bands.items())}


def _descend(r: np.ndarray, c: np.ndarray, penalty: float, lasso: float, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent on correlations: cost b'Rb/2 - c'b + penalty (lasso |b| + (1 - lasso) b'b / 2)."""
    b, slope = np.zeros(len(c)), c.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(c)):
            if r[j, j] == 0:
                continue
            pull = slope[j] + r[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - penalty * lasso, 0.0) / (r[j, j] + penalty * (1 - lasso))
            if new != b[j]:
                slope -= r[j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < 1e-9:
            break
    return b


def solved(sums: np.ndarray, width: int, models: Mapping[str, Linear]) -> dict[str, np.ndarray]:
    """Coefficients (1 + width) x outputs of each model, the intercept first; a constant feature gets 0.

    Without a penalty the shortest of all best solutions is taken.
    """
    mean = sums[0, 1:] / sums[0, 0]
    spread = sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)
    square = np.clip(np.diag(spread), 0, None)
    live = square > 1e-14 * np.maximum(1.0, mean * mean)
    scale = np.where(live, np.sqrt(square), 1.0)
    unit = np.where(np.outer(live, live), spread / np.outer(scale, scale), 0.0)
    r, c = unit[:width, :width], unit[:width, width:]
    values, axes = np.linalg.eigh(r)
    turned = axes.T @ c
    found = {}
    for name, model in models.items():
        if model.lasso:
            b = np.column_stack([_descend(r, c[:, k], model.penalty, model.lasso) for k in range(c.shape[1])])
        else:
            weak = values <= RANK * max(values[-1], 0.0) if model.penalty == 0 else np.zeros(width, bool)
            b = axes @ np.where(weak[:, None], 0.0, turned / np.where(weak, 1.0, values + model.penalty)[:, None])
        b = b * scale[width:] / scale[:width, None]
        found[name] = np.vstack([mean[width:] - mean[:width] @ b, b])
    return found


def squared_error(sums: np.ndarray, width: int, b: np.ndarray) -> float:
    """Mean squared error of coefficients over the rows and targets behind ``sums``."""
    inner, cross = sums[:1 + width, :1 + width], sums[:1 + width, 1 + width:]
    total = np.trace(sums[1 + width:, 1 + width:]) - 2 * (b * cross).sum() + (b * (inner @ b)).sum()
    return float(max(total, 0.0) / (sums[0, 0] * b.shape[1]))


def _model_schema(products: DataFrame, by: Sequence[str]) -> T.StructType:
    return T.StructType([*(products.schema[c] for c in by), T.StructField("model", T.StringType()),
                         T.StructField("fold", T.IntegerType()), T.StructField("loss", T.DoubleType()),
                         T.StructField("outputs", T.IntegerType()), T.StructField("weights", T.BinaryType())])


def _model_table(table: pa.Table, by: Sequence[str], schema: T.StructType, rows: list[tuple]) -> pa.Table:
    same = [pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in by]
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([*same, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)


def left_out_models(products: DataFrame, by: Sequence[str], models: Mapping[str, Linear], all_as: int = -1) -> DataFrame:
    """Coefficients of each model of each group with each fold left out, and of all rows (as fold ``all_as``)."""
    schema = _model_schema(products, by)

    def fit(table: pa.Table) -> pa.Table:
        width, folds = _by_fold(table)
        total, rows = sum(folds.values()), []
        for fold in [*folds, all_as]:
            seen = total - folds[fold] if fold in folds else total
            if seen[0, 0] > 0.5:
                rows += [(name, fold, None, b.shape[1], b.tobytes()) for name, b in solved(seen, width, models).items()]
        return _model_table(table, by, schema, rows)

    return products.groupBy(*by).applyInArrow(fit, schema)


def validated_models(products: DataFrame, by: Sequence[str], models: Mapping[str, Linear], train: int, validation: int) -> DataFrame:
    """Every model's ``loss`` on the validation fold, and of each group's best one the coefficients of both folds.

    ``weights`` is null but for the model of least loss (the first of equals), refitted on both folds.
    """
    schema = _model_schema(products, by)

    def fit(table: pa.Table) -> pa.Table:
        width, folds = _by_fold(table)
        if train not in folds or validation not in folds:
            return _model_table(table, by, schema, [])
        loss = {name: squared_error(folds[validation], width, b) for name, b in solved(folds[train], width, models).items()}
        best = min(loss, key=loss.get)
        b = solved(folds[train] + folds[validation], width, {best: models[best]})[best]
        rows = [(name, None, v, b.shape[1], b.tobytes() if name == best else None) for name, v in loss.items()]
        return _model_table(table, by, schema, rows)

    return products.groupBy(*by).applyInArrow(fit, schema)


def predicted(rows: DataFrame, fitted: DataFrame, by: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """by, ``carry``, model, ``y`` and ``yhat`` (arrays) of each row and model of the row's group and fold.

    Models without a fold serve all rows. Coefficients are sent to every block of their group.
    """
    ship_package(rows.sparkSession)
    by = list(by)
    schema = T.StructType([*(rows.schema[c] for c in (*by, *carry)), T.StructField("model", T.StringType()),
                           T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("yhat", T.ArrayType(T.DoubleType()))])
    sent = fitted.where("weights is not null").select(*by, "model", F.col("fold").alias("held"), "outputs", "weights")
    models = rows.select(*by, "block").distinct().join(sent, by).select(
        *[F.col(c).alias(c) for c in (*by, "block", "model", "held", "outputs", "weights")])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        z, y = np.empty((0, 1)), np.empty((0, 1))
        if left.num_rows:
            x, y = _matrix(left.column("features")), _matrix(left.column("targets"))
            z = np.column_stack([np.ones(len(x)), x])
        folds = left.column("fold").to_numpy()
        for model, held, outputs, weights in zip(
                *(right.column(c).to_pylist() for c in ("model", "held", "outputs", "weights")), strict=True):
            own = np.flatnonzero(folds == held) if held is not None else np.arange(left.num_rows)
            if not len(own):
                continue
            said = z[own] @ np.frombuffer(weights).reshape(-1, outputs)
            ends = pa.array(np.arange(0, said.size + 1, outputs), pa.int32())
            kept = left.select([*by, *carry]).take(pa.array(own))
            parts.append(pa.Table.from_arrays(
                [*kept.columns, pa.array([model] * len(own)), pa.ListArray.from_arrays(ends, pa.array(y[own].ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(said.ravel()))], names=schema.names))
        if not parts:
            empty = [pa.array([], left.schema.field(c).type) for c in (*by, *carry)]
            lists = pa.list_(pa.float64())
            return pa.Table.from_arrays([*empty, pa.array([], pa.string()), pa.array([], lists), pa.array([], lists)], names=schema.names)
        return pa.concat_tables(parts)

    return rows.select(*by, *[c for c in carry if c != "fold"], "fold", "block", "features", "targets").groupBy(
        *by, "block").cogroup(models.groupBy(*by, "block")).applyInArrow(score, schema)
