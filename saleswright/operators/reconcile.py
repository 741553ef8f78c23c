"""Reconciliation: make forecasts of all levels add up.

Base forecasts come as nodes: level, store_nbr, family, ds, y_hat; the store × family grid is full.
Every method yields coherent bottom values; :func:`aggregate_levels` derives the rest. Sums along an
axis are aggregated first (with map-side combine) and joined back, so no period or store has to fit
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOTTOM, FAMILY, STORE, TOTAL
from ..sources.stages import materialised
from .evaluate import metrics
from .hierarchy import aggregate_levels, node_key


def _at(level: str, value: str = "y_hat") -> Column:
    return F.when(F.col("level") == level, F.col(value))


def _with_axes(nodes: DataFrame) -> DataFrame:
    """Bottom rows next to the forecasts and sums of their period, store and family."""
    per_period = nodes.groupBy("ds").agg(
        F.max(_at(TOTAL)).alias("t"),
        F.sum(_at(STORE)).alias("sum_s"),
        F.sum(_at(FAMILY)).alias("sum_f"),
        F.sum(_at(BOTTOM)).alias("sum_b"),
        F.count(_at(STORE)).alias("n_s"),
        F.count(_at(FAMILY)).alias("n_f"),
    )
    by_store = nodes.where(F.col("level").isin(STORE, BOTTOM)).groupBy("ds", "store_nbr").agg(
        F.max(_at(STORE)).alias("s"), F.sum(_at(BOTTOM)).alias("s_sum_b")
    )
    by_family = nodes.where(F.col("level").isin(FAMILY, BOTTOM)).groupBy("ds", "family").agg(
        F.max(_at(FAMILY)).alias("f"), F.sum(_at(BOTTOM)).alias("f_sum_b")
    )
    bottom = nodes.where(F.col("level") == BOTTOM).select("ds", "store_nbr", "family", "y_hat")
    return bottom.join(by_store, ["ds", "store_nbr"]).join(by_family, ["ds", "family"]).join(per_period, "ds")


def _coherent(bottom: DataFrame, value: Column) -> DataFrame:
    return aggregate_levels(bottom.select("ds", "store_nbr", "family", value.alias("y_hat")), "y_hat")


def bottom_up(nodes: DataFrame) -> DataFrame:
    return _coherent(nodes.where(F.col("level") == BOTTOM), F.col("y_hat"))


def top_down(nodes: DataFrame) -> DataFrame:
    """Forecast proportions along Total → Store → Bottom; an all-zero group is shared out as 0."""
    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    value = F.col("t") * share(F.col("s"), F.col("sum_s")) * share(F.col("y_hat"), F.col("s_sum_b"))
    return _coherent(_with_axes(nodes), value)


def mint_ols(nodes: DataFrame) -> DataFrame:
    """Least-squares reconciliation in closed form.

    For S stores and F families SᵀS = (I+J)⊗(I+J), whose inverse is (I − J/(1+S))⊗(I − J/(1+F)). Applied
    to v = bottom + store + family + total this takes off the means of v along each axis: sums only.
    """
    t, s, f, b = F.col("t"), F.col("s"), F.col("f"), F.col("y_hat")
    n_s, n_f = F.col("n_s"), F.col("n_f")
    v = b + s + f + t
    over_families = F.col("s_sum_b") + n_f * s + F.col("sum_f") + n_f * t
    over_stores = F.col("f_sum_b") + F.col("sum_s") + n_s * f + n_s * t
    over_all = F.col("sum_b") + n_f * F.col("sum_s") + n_s * F.col("sum_f") + n_s * n_f * t
    value = v - over_families / (1 + n_f) - over_stores / (1 + n_s) + over_all / ((1 + n_s) * (1 + n_f))
    return _coherent(_with_axes(nodes), value)


def mint_shrink(nodes: DataFrame, residuals: DataFrame) -> DataFrame:
    """Minimum-trace reconciliation with a shrunk residual covariance.

    ``residuals``: level, node_id, store_nbr, family, ds, e, one value per node and day. With C the matrix
    of constraints (aggregate − sum of its bottom series), ỹ = ŷ − W Cᵀ (C W Cᵀ)⁻¹ C ŷ and
    W = λ·diag(Ŵ) + (1−λ)·Ŵ. Neither Ŵ nor C W Cᵀ is formed: the system is solved by conjugate gradients,
    whose products need the incoherence of the residuals (aggregates × days) and, from Spark, sums of the
    weighted bottom series along the axes. The driver holds what belongs to aggregates (stores, families,
    total), never the bottom.
    """
    # The panel is read several times below: write it once, so that no step repeats what led to it.
    panel = materialised(_residual_panel(residuals), "residual_panel")
    n_days, fewest = panel.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if fewest != n_days:
        raise ValueError("residuals miss days for some nodes")

    lam = shrinkage(panel, n_days)
    variance = panel.select("level", "node_id", "store_nbr", "family", "variance")

    # Incoherence of residuals (aggregates × days) and of the forecasts (aggregates × periods).
    centred = panel.select("level", "node_id", "store_nbr", "family", F.posexplode("x").alias("ds", "y_hat"))
    gap = _incoherence(centred).toPandas().pivot(index="node_id", columns="ds", values="gap").sort_index()
    order = list(gap.index)
    d = gap.to_numpy()
    c_y = _incoherence(nodes).toPandas().pivot(index="node_id", columns="ds", values="gap").reindex(order)
    z = _conjugate_gradients(variance, order, d, lam, n_days, c_y.to_numpy())
    u = d.T @ z

    # Corrections go back as tables of aggregates × periods and of one array of days per period.
    spark = nodes.sparkSession
    ds_type = nodes.schema["ds"].dataType.simpleString()
    periods = list(c_y.columns)
    multipliers = spark.createDataFrame(
        [(node, str(ds), float(z[i, h])) for i, node in enumerate(order) for h, ds in enumerate(periods)],
        "node_id string, ds string, z double",
    ).withColumn("ds", F.col("ds").cast(ds_type))
    day_weights = spark.createDataFrame(
        [(str(ds), [float(w) for w in u[:, h]]) for h, ds in enumerate(periods)], "ds string, u array<double>"
    ).withColumn("ds", F.col("ds").cast(ds_type))

    store, family = F.col("store_nbr"), F.col("family")
    bottom = nodes.where(F.col("level") == BOTTOM).select("ds", "store_nbr", "family", "y_hat")
    for level, name in ((TOTAL, "z_t"), (STORE, "z_s"), (FAMILY, "z_f")):
        bottom = bottom.withColumn("node_id", node_key(F.lit(level), store, family)).join(
            multipliers.withColumnRenamed("z", name), ["node_id", "ds"]
        ).drop("node_id")
    weights = panel.where(F.col("level") == BOTTOM).select("store_nbr", "family", "variance", "x")
    joined = bottom.join(weights, ["store_nbr", "family"]).join(day_weights, "ds")
    along_days = F.aggregate(F.zip_with("x", "u", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    value = (
        F.col("y_hat")
        + F.lit(lam) * F.col("variance") * (F.col("z_t") + F.col("z_s") + F.col("z_f"))
        - F.lit((1 - lam) / (n_days - 1)) * along_days
    )
    return _coherent(joined, value)


def _residual_panel(residuals: DataFrame) -> DataFrame:
    """Per node: residuals in day order around their mean, and their sample variance."""
    per_node = residuals.groupBy("level", "node_id", "store_nbr", "family").agg(
        F.sort_array(F.collect_list(F.struct("ds", "e"))).alias("_e"), F.avg("e").alias("_mean"), F.var_samp("e").alias("variance")
    )
    return per_node.select(
        "level", "node_id", "store_nbr", "family", "variance",
        F.transform("_e", lambda r: r["e"] - F.col("_mean")).alias("x"),
    )


def shrinkage(panel: DataFrame, n_days: int) -> float:
    """λ = Σ Var(r_ij) / Σ r_ij² over pairs i ≠ j, from sums over nodes and one day × day Gram matrix."""
    t = float(n_days)
    scale = F.sqrt("variance")
    z = panel.where(F.col("variance") > 0).select(F.transform("x", lambda v: v / scale).alias("z"))
    n, fourth = z.agg(
        F.count(F.lit(1)), F.sum(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v * v * v))
    ).first()
    if not n:
        return 1.0
    vectors = MLUtils.convertVectorColumnsFromML(z.select(array_to_vector("z").alias("z")), "z")
    gram = RowMatrix(vectors).computeGramianMatrix().toArray()
    pairs_of_products = float((np.diag(gram) ** 2).sum()) - float(fourth)
    gram_norm = float((gram**2).sum())
    off_diagonal = gram_norm - n * (t - 1) ** 2
    spread = t / (t - 1) ** 3 * (pairs_of_products - off_diagonal / t)
    correlation = off_diagonal / (t - 1) ** 2
    return float(min(1.0, max(0.0, spread / correlation))) if correlation > 0 else 1.0


def _incoherence(nodes: DataFrame) -> DataFrame:
    """node_id, ds, gap = value of an aggregate − sum of the bottom series below it."""
    sums = aggregate_levels(nodes.where(F.col("level") == BOTTOM), "y_hat").where(F.col("level") != BOTTOM)
    own = nodes.where(F.col("level") != BOTTOM).select(
        node_key(F.col("level"), F.col("store_nbr"), F.col("family")).alias("node_id"), "ds", F.col("y_hat").alias("_own")
    )
    return own.join(sums.select("node_id", "ds", "y_hat"), ["node_id", "ds"]).select(
        "node_id", "ds", (F.col("_own") - F.col("y_hat")).alias("gap")
    )


def _conjugate_gradients(variance: DataFrame, order: list[str], d: np.ndarray, lam: float, n_days: int, right: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """z with (λ C diag(v) Cᵀ + (1−λ)/(days−1) D Dᵀ) z = right, for all periods (columns) at once.

    C diag(v) Cᵀ z is, for an aggregate, its own variance times z plus the sum of v·(z of total, store and family)
    over the bottom series below it: one pass over the bottom cells, summed by store, family and in all.
    """
    spark = variance.sparkSession
    store, family = F.col("store_nbr"), F.col("family")
    own = variance.where(F.col("level") != BOTTOM).select("node_id", "variance").toPandas().set_index("node_id")["variance"].reindex(order).to_numpy()
    cells = materialised(
        variance.where(F.col("level") == BOTTOM).select(
            node_key(F.lit(STORE), store, family).alias("s"), node_key(F.lit(FAMILY), store, family).alias("f"), F.col("variance").alias("v")), "cells")
    at = {node: i for i, node in enumerate(order)}
    width = right.shape[1]

    def below(z: np.ndarray) -> np.ndarray:
        """Σ v·(z_total + z_store + z_family) over the bottom series of each aggregate."""
        rows = spark.createDataFrame([(node, [float(x) for x in z[i]]) for node, i in at.items()], "node string, z array<double>")
        total = F.array(*[F.lit(float(x)) for x in z[at[TOTAL]]])
        spread = cells.join(rows.select(F.col("node").alias("s"), F.col("z").alias("zs")), "s").join(rows.select(F.col("node").alias("f"), F.col("z").alias("zf")), "f")
        sums = [F.sum(F.col("v") * (total[h] + F.col("zs")[h] + F.col("zf")[h])).alias(f"h{h}") for h in range(width)]
        out = np.zeros((len(order), width))
        for r in spread.groupingSets([["s"], ["f"], []], "s", "f").agg(*sums).collect():  # a row for each aggregate
            out[at[r["s"] or r["f"] or TOTAL]] = [r[f"h{h}"] for h in range(width)]
        return out

    def product(z: np.ndarray) -> np.ndarray:
        return lam * (own[:, None] * z + below(z)) + (1 - lam) / (n_days - 1) * (d @ (d.T @ z))

    # Scaled by the diagonal: the variance of each aggregate and of all bottom series below it.
    sums = {r["s"] or r["f"] or TOTAL: r["v"] for r in cells.groupingSets([["s"], ["f"], []], "s", "f").agg(F.sum("v").alias("v")).collect()}
    diagonal = lam * (own + np.array([sums[node] for node in order])) + (1 - lam) / (n_days - 1) * (d * d).sum(axis=1)
    scale = 1 / np.where(diagonal > 0, diagonal, 1)[:, None]
    z = np.zeros_like(right)
    rest = right.copy()
    step = scale * rest
    direction, size = step, (rest * step).sum(axis=0)
    first = size.copy()
    for _ in range(20 * len(order) + 20):
        moving = size > tol**2 * first
        if not moving.any():
            break
        image = product(direction)
        length = np.where(moving, size / np.where(moving, (direction * image).sum(axis=0), 1), 0)
        z, rest = z + length * direction, rest - length * image
        step = scale * rest
        new = (rest * step).sum(axis=0)
        direction = step + np.where(moving, new / np.where(size > 0, size, 1), 0) * direction
        size = new
    return z


METHODS: dict[str, Callable[..., DataFrame]] = {
    "BottomUp": bottom_up,
    "TopDown": top_down,
    "MinTrace_ols": mint_ols,
    "MinTrace_shrink": mint_shrink,
}


def reconcile(nodes: DataFrame, methods: Sequence[str] = ("BottomUp", "TopDown", "MinTrace_ols"), residuals: DataFrame | None = None, model: str = "model") -> DataFrame:
    """Several methods side by side in long form: method (``model/method``), level, node_id, ds, y_hat."""
    parts = []
    for name in methods:
        result = mint_shrink(nodes, residuals) if name == "MinTrace_shrink" else METHODS[name](nodes)
        parts.append(result.select(F.lit(f"{model}/{name}").alias("method"), "level", "node_id", "store_nbr", "family", "ds", "y_hat"))
    return reduce(DataFrame.unionByName, parts)


def wide(reconciled: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One column per method."""
    return reconciled.groupBy("level", "node_id", "ds").pivot("method", list(methods)).agg(F.first("y_hat"))


def join_actuals(forecast: DataFrame, actual: DataFrame, key: str = "unique_id") -> DataFrame:
    return forecast.join(actual, [key, "ds"])


def evaluate_levels(reconciled: DataFrame, actual_nodes: DataFrame) -> DataFrame:
    """mape, rmse, mae and n per method and level; a level without matching rows does not show up."""
    both = join_actuals(reconciled, actual_nodes.select("node_id", "ds", "y"), "node_id")
    return metrics(both, ["method", "level"]).select("method", "level", "mape", "rmse", "mae", "n_samples")


def check_coherence(nodes: DataFrame, tol: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between each published aggregate and the sum of its bottom series, per level."""
    key = ["ds", *by]
    bottoms = nodes.where(F.col("level") == BOTTOM)
    parts = []
    for level, cols in ((TOTAL, []), (STORE, ["store_nbr"]), (FAMILY, ["family"])):
        sums = bottoms.groupBy(*key, *cols).agg(F.sum("y_hat").alias("_sum"))
        own = nodes.where(F.col("level") == level).select(*key, *cols, "y_hat")
        parts.append(own.join(sums, [*key, *cols], "left").select(*by, F.lit(level).alias("level"), "y_hat", "_sum"))
    gap = F.abs(F.col("y_hat") - F.coalesce("_sum", F.lit(0.0)))
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "level").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(gap).alias("max_gap"), F.bool_and(gap <= tol).alias("coherent")
    )
