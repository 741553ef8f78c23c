"""Error metrics per group, daily accuracy, comparison statistics, leaderboards and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import mae, mape, rmse, rmsle, scored_rows, sign_label

METRICS = ("rmsle", "rmse", "mae", "mape")


def metric_columns(y: str = "y", p: str = "y_hat") -> list[Column]:
    a, b = F.col(y), F.col(p)
    return [
        rmsle(a, b).alias("rmsle"),
        rmse(a, b).alias("rmse"),
        mae(a, b).alias("mae"),
        mape(a, b).alias("mape"),
        scored_rows(a, b).alias("n_samples"),
    ]


def metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "y_hat") -> DataFrame:
    """All metrics and the number of rows with both values, per group, in one aggregation."""
    return df.groupBy(*by).agg(*metric_columns(y, p))


def daily_accuracy(df: DataFrame, y: str = "sales", p: str = "predicted", date: str = "date") -> DataFrame:
    """Totals per day, signed error, and percent error (null where nothing was sold)."""
    totals = df.groupBy(date).agg(F.sum(y).alias("actual"), F.sum(p).alias("predicted"))
    error = F.col("actual") - F.col("predicted")
    return totals.withColumns({"error": error, "mape": F.try_divide(F.abs(error), F.col("actual")) * 100})


def accuracy_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("data_points"),
        F.avg("actual").alias("mean_actual"),
        F.avg("predicted").alias("mean_predicted"),
        F.avg("error").alias("mean_error"),
        F.avg("mape").alias("mean_mape"),
        F.corr("actual", "predicted").alias("correlation"),
    )


def error_band(daily: DataFrame) -> DataFrame:
    width = F.abs("error")
    return daily.withColumns({"error_upper": F.col("predicted") + width, "error_lower": F.col("predicted") - width})


def calibration(summary: DataFrame) -> DataFrame:
    return summary.withColumn("calibration", sign_label(F.col("mean_error"), "over", "under", "accurate"))


def forecast_stats(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of actual and forecast (0 if there is none), direction, size of the change, forecast range."""
    stats = points.groupBy(*by).agg(
        F.coalesce(F.avg("actual"), F.lit(0.0)).alias("avg_actual"),
        F.coalesce(F.avg("forecast"), F.lit(0.0)).alias("avg_forecast"),
        F.min("forecast").alias("min_forecast"),
        F.max("forecast").alias("max_forecast"),
    )
    change = F.col("avg_forecast") - F.col("avg_actual")
    return stats.withColumns(
        {
            "trend": sign_label(change, "up", "down", "stable"),
            "trend_percent": F.when(F.col("avg_actual") > 0, F.abs(change / F.col("avg_actual")) * 100).otherwise(0.0),
        }
    )


def comparison_stats(points: DataFrame, a: str = "store_a", b: str = "store_b", by: Sequence[str] = ()) -> DataFrame:
    """Totals, means and their difference over the dates both series have; zeros if there is none."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()

    def over_both(agg: Column) -> Column:
        return F.coalesce(agg, F.lit(0.0))

    stats = points.groupBy(*by).agg(
        F.count_if(both).alias("n_points"),
        over_both(F.sum(F.when(both, F.col(a)))).alias("total_a"),
        over_both(F.sum(F.when(both, F.col(b)))).alias("total_b"),
        over_both(F.avg(F.when(both, F.col(a)))).alias("avg_a"),
        over_both(F.avg(F.when(both, F.col(b)))).alias("avg_b"),
    )
    delta = F.col("avg_a") - F.col("avg_b")
    return stats.withColumns(
        {
            "avg_delta": delta,
            "avg_delta_pct": F.when(F.col("avg_b") == 0, 0.0).otherwise(F.try_divide(delta, F.col("avg_b")) * 100),
            "comparison": sign_label(delta, "higher", "lower", "equal"),
        }
    )


def leaderboard(scores: DataFrame, metric: str = "rmsle", model: str = "model") -> DataFrame:
    """Models from best to worst, with the improvement of the best over the worst.

    ``scores`` holds one row per model, so ordering it as a whole is no burden. Names break ties.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(metric, model)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, worst = F.first(metric).over(whole), F.last(metric).over(whole)
    position = F.row_number().over(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return scores.where(F.col(metric).isNotNull()).select(
        model,
        metric,
        position.alias("position"),
        (position == 1).alias("is_best"),
        (position == n).alias("is_worst"),
        F.when(n > 1, F.try_divide(worst - best, worst) * 100).otherwise(0.0).alias("improvement_percent"),
    )


def best_method(evaluation: DataFrame, metric: str = "rmse", level: str | None = None) -> DataFrame:
    """The method with the lowest mean of the metric, over all levels or one."""
    rows = evaluation if level is None else evaluation.where(F.col("level") == level)
    return (
        rows.groupBy("method").agg(F.avg(metric).alias("score"))
        .where(F.col("score").isNotNull())
        .agg(F.min(F.struct("score", "method")).alias("_best"))
        .where(F.col("_best").isNotNull())
        .select("_best.method", "_best.score")
    )


def model_metrics(predictions: DataFrame, y: str = "y", p: str = "y_hat") -> DataFrame:
    return metrics(predictions, ["model"], y, p)


def compare_predictions(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "y_hat", rtol: float = 1e-3, atol: float = 1e-5
) -> DataFrame:
    """Do two scorings agree? ``b`` is the expected one; a key on one side only is a disagreement."""
    left = a.select(*keys, F.col(value).alias("_a"))
    right = b.select(*keys, F.col(value).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    diff = F.abs(F.col("_a") - F.col("_b"))
    close = F.coalesce(diff <= F.lit(atol) + F.lit(rtol) * F.abs("_b"), F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bool_and(close), F.lit(True)).alias("all_close"),
        F.max(diff).alias("max_abs_diff"),
        F.max(diff / (F.abs("_b") + F.lit(1e-8))).alias("max_rel_diff"),
    )


def feature_importance(contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy(*by, "feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(*by, F.desc("importance"), "feature")
    )
