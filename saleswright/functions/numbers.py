"""Safe ratios, trend classes and the error-metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_zero(x: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change against ``previous``; 0 for a base of 0."""
    return F.when(previous == 0, F.lit(0.0)).otherwise(F.try_divide(current - previous, previous) * 100)


def trend_class(percent: Column, threshold: float = 1.0) -> Column:
    return (
        F.when(percent > threshold, "up")
        .when(percent < -threshold, "down")
        .when(percent.isNotNull(), "stable")
    )


def sign_label(x: Column, above: str, below: str, equal: str) -> Column:
    return F.when(x > 0, above).when(x < 0, below).when(x == 0, equal)


def rmsle(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared_error(F.log1p(floor_zero(y)), F.log1p(floor_zero(p)))))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared_error(y, p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column, epsilon: float = 1.0) -> Column:
    return F.avg(F.abs(y - p) / (F.abs(y) + F.lit(epsilon)))


def scored_rows(y: Column, p: Column) -> Column:
    return F.count(y + p)
