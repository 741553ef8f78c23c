"""Least squares for every group at once: moments in one aggregation, one small solve a group.

Made for the folds of a cross-validation, where a fit per fold would read the rows once for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .split import TRAIN, VALID, Forecaster

#: Groups whose moments a task holds before it hands them on.
HELD = 1024
#: Deviation, as a part of that over all rows, below which an input counts as constant in a group.
CONSTANT = 1e-7


def _number(column: str) -> Column:
    """An input as the model sees it: null and NaN count as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def _moments(batches: Iterator[pa.RecordBatch], by: list[str], schema: pa.Schema, center: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each group of the rows: sums of products of (1, inputs, target), the upper triangle by rows."""
    upper = np.triu_indices(len(center) + 1)
    held: dict[tuple, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        rows = [dict(zip(by, k)) | {"moments": v[upper].tolist()} for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        values = np.column_stack([batch.column(i).to_numpy() for i in range(len(by), batch.num_columns)])
        z = np.column_stack([np.ones(len(values)), (values - center) / scale])
        keys = pa.Table.from_batches([batch.select(by)])
        codes = keys.append_column("_at", pa.array(np.arange(len(z)))).group_by(by).aggregate([("_at", "list")])
        for key in codes.to_pylist():
            mine = z[key.pop("_at_list")]
            k = tuple(key[c] for c in by)
            held[k] = held.get(k, 0.0) + mine.T @ mine
        if len(held) >= HELD:
            yield handed()
    yield handed()


def _solved(batches: Iterator[pd.DataFrame], by: list[str], center: np.ndarray, scale: np.ndarray) -> Iterator[pd.DataFrame]:
    size = len(center) + 1
    upper = np.triu_indices(size)
    for batch in batches:
        fits = []
        for moments in batch["moments"]:
            m = np.zeros((size, size))
            m[upper] = moments
            mean = m[0, 1:] / m[0, 0]
            cov = (m + np.triu(m, 1).T)[1:, 1:] / m[0, 0] - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
            live = np.flatnonzero(spread > CONSTANT)
            beta = np.zeros(size - 2)
            if len(live):
                s = spread[live]
                beta[live] = np.linalg.lstsq(cov[np.ix_(live, live)] / np.outer(s, s), cov[live, -1] / s, rcond=1e-10)[0] / s
            at = center + scale * mean
            fits.append((int(round(m[0, 0])), float(at[-1]), (beta * scale[-1] / scale[:-1]).tolist(), at[:-1].tolist()))
        yield pd.concat([batch[by].reset_index(drop=True), pd.DataFrame(fits, columns=["n", "base", "betas", "means"])], axis=1)


def fit_groups(rows: DataFrame, by: Sequence[str], features: Sequence[str], target: str = "sales") -> DataFrame:
    """(by…, n, base, betas, means): the least-squares line of each group, prediction = base + Σ beta·(x − mean).

    The rows are read twice whatever the number of groups: once for one mean and deviation per input, which only
    keep the sums well conditioned, and once for the products. These are summed in each task
    before anything is shuffled, so a group of any size is a few numbers from each task. Missing inputs count as 0,
    rows without a target are left out, and a group of such rows alone has no model. An input that is constant in a group has
    slope 0; of inputs that depend on each other the solution of least norm is taken. Null keys are a group.
    """
    by = list(by)
    inputs = [*(_number(f).alias(f"_x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("_y")]
    ready = rows.select(*by, *inputs).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    names = ready.columns[len(by):]
    stats = ready.agg(F.array(*[F.avg(c) for c in names]), F.array(*[F.stddev_pop(c) for c in names])).first()
    center, scale = (np.nan_to_num(np.array(v, float)) for v in stats)
    scale[scale == 0] = 1.0
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*by).schema)
    out = f"{keys}, moments array<double>"
    arrow = ready.sparkSession.createDataFrame([], out).toArrow().schema
    parts = ready.mapInArrow(lambda b: _moments(b, by, arrow, center, scale), out)
    sums = parts.select(*by, F.posexplode("moments").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    listed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("m"))
    moments = listed.select(*by, F.transform("m", lambda p: p["v"]).alias("moments"))
    return moments.mapInPandas(lambda b: _solved(b, by, center, scale), f"{keys}, n long, base double, betas array<double>, means array<double>")


def score_groups(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Add the prediction of each row's group; null where the group has no model. Null keys meet."""
    model = models.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.struct("base", "betas", "means").alias("_model"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    terms = F.zip_with("_model.betas", F.zip_with(F.array(*[_number(f) for f in features]), "_model.means", lambda x, m: x - m), lambda b, x: b * x)
    scored = rows.join(model, same, "left").withColumn(out, F.col("_model.base") + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    return scored.drop("_model", *[f"_by{i}" for i in range(len(by))])


def fold_forecaster(features: Sequence[str], target: str = "sales") -> Forecaster:
    """Least squares trained anew in each fold, all folds at once: a model for :func:`~saleswright.operators.split.cross_validate`."""

    def predict(rows: DataFrame) -> DataFrame:
        models = materialised(fit_groups(rows.where(F.col("role") == TRAIN), ["fold"], features, target), "fold_models")
        scored = score_groups(rows.where(F.col("role") == VALID), models, ["fold"], features, "y_hat")
        return scored.select("fold", "unique_id", F.col("date").alias("ds"), F.col(target).alias("y"), "y_hat")

    return predict
