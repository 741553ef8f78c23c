"""Time splits and walk-forward folds, all as columns of one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import metrics
from .facts import latest

TRAIN, VALID = "train", "valid"


def time_split(df: DataFrame, days: int, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows before ``max(date) - days``, and rows from then on."""
    border = F.date_sub(latest(df.select(date), date), days)
    marked = df.withColumn("_border", border)
    return (
        marked.where(F.col(date) < F.col("_border")).drop("_border"),
        marked.where(F.col(date) >= F.col("_border")).drop("_border"),
    )


def fold_table(
    df: DataFrame, train_days: int = 365, valid_days: int = 90, gap_days: int = 0,
    n_splits: int = 3, step_days: int = 30, date: str = "date",
) -> Column:
    """Array of folds, from the latest backwards, as a scalar.

    A fold stays if its training range starts within the data and both of its sides hold a row. What
    decides is the set of dates of the data, which the calendar bounds, so this is one small aggregate.
    """
    dates = df.agg(F.collect_set(date).alias("dates")).where(F.size("dates") > 0)
    spans = dates.select(
        "dates",
        F.array_min("dates").alias("first"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda i: F.date_sub(F.array_max("dates"), i * step_days))
        ).alias("pos", "valid_end"),
    )
    spans = spans.withColumn("valid_start", F.date_sub("valid_end", valid_days))
    spans = spans.withColumn("train_end", F.date_sub("valid_start", gap_days))
    spans = spans.withColumn("train_start", F.date_sub("train_end", train_days))

    def some(start: str, end: str, closed: bool) -> Column:
        upper = (lambda d: d <= F.col(end)) if closed else (lambda d: d < F.col(end))
        return F.exists("dates", lambda d: (d >= F.col(start)) & upper(d))

    kept = spans.where(
        (F.col("train_start") >= F.col("first"))
        & some("train_start", "train_end", closed=False)
        & some("valid_start", "valid_end", closed=True)
    )
    listed = kept.agg(
        F.sort_array(F.collect_list(F.struct("pos", "train_start", "train_end", "valid_start", "valid_end"))).alias("f")
    )
    return listed.select("f").scalar()


def folds(df: DataFrame, **options: object) -> DataFrame:
    """The fold borders, one row per fold, numbered from 1."""
    bounds = df.agg(F.lit(1).alias("_one")).withColumn("_folds", fold_table(df, **options))
    return bounds.select(F.posexplode("_folds").alias("_pos", "_fold")).select(
        (F.col("_pos") + 1).alias("fold"),
        "_fold.train_start", "_fold.train_end", "_fold.valid_start", "_fold.valid_end",
    )


def walk_forward(df: DataFrame, date: str = "date", **options: object) -> DataFrame:
    """``df`` with a row per fold and role it takes part in: ``fold`` and ``role``.

    Validation ranges include both ends, training ranges exclude their last day.
    """
    d = F.col(date)

    def membership(f: Column, i: Column) -> Column:
        role = F.when((d >= f["train_start"]) & (d < f["train_end"]), TRAIN).when(
            (d >= f["valid_start"]) & (d <= f["valid_end"]), VALID
        )
        return F.struct((i + 1).alias("fold"), role.alias("role"))

    table = fold_table(df.select(date), date=date, **options)
    placed = df.withColumn("_folds", table).withColumn("_folds", F.transform("_folds", membership))
    return (
        placed.withColumn("_m", F.explode(F.filter("_folds", lambda m: m["role"].isNotNull())))
        .withColumns({"fold": F.col("_m.fold"), "role": F.col("_m.role")})
        .drop("_folds", "_m")
    )


Forecaster = Callable[[DataFrame], DataFrame]
"""Takes rows with fold, role, unique_id, ds, y; returns fold, unique_id, ds, y, y_hat of the valid rows."""


def cross_validate(model: Forecaster, fold_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics per fold, and one row of pooled metrics with mean and deviation of the folds' RMSLE.

    Pooled metrics are put together from the folds' own, weighted by their rows: the mean over all rows
    without scoring them a second time.
    """
    per_fold = metrics(model(fold_rows), ["fold"])
    n = F.col("n_samples")

    def pooled(mean: Column) -> Column:
        return F.try_divide(F.sum(mean * n), F.sum(n))

    return per_fold, per_fold.agg(
        F.sqrt(pooled(F.col("rmsle") * F.col("rmsle"))).alias("rmsle"),
        F.sqrt(pooled(F.col("rmse") * F.col("rmse"))).alias("rmse"),
        pooled(F.col("mae")).alias("mae"),
        pooled(F.col("mape")).alias("mape"),
        F.sum(n).alias("n_samples"),
        F.avg("rmsle").alias("mean_rmsle"),
        F.stddev_pop("rmsle").alias("std_rmsle"),
        F.count(F.lit(1)).alias("n_splits"),
    )
