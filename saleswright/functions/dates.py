"""Calendar columns and weekly date grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_weekday(day: Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(day) + 1


def date_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "dayofweek": iso_weekday(d),
            "dayofyear": F.dayofyear(d),
            "is_mid_month": (F.dayofmonth(d) == 15).cast("int"),
            "is_leap_year": (
                F.dayofmonth(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29
            ).cast("int"),
            "week_of_month": F.ceil(F.dayofmonth(d) / 7).cast("int"),
            "quarter": F.quarter(d),
        }
    )


def _weekly(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 7 days"))


def forecast_grid(df: DataFrame, start: str = "date", horizon: str = "horizon", out: str = "ds") -> DataFrame:
    """One row per week of the horizon: ``ceil(horizon / 7)`` dates, the first one being ``start``."""
    weeks = F.ceil(F.col(horizon) / 7).cast("int")
    first = F.col(start)
    return df.where(F.col(horizon) > 0).withColumn(
        out, F.explode(_weekly(first, F.date_add(first, (weeks - 1) * 7)))
    )


def history_days(days: Column, default: int = 28, cap: int = 365) -> Column:
    """Length of history asked for: missing or non-positive means the default, and no more than the cap."""
    return F.when(days > 0, F.least(days, F.lit(cap))).otherwise(F.lit(default))


def history_grid(df: DataFrame, end: str = "end_date", days: str = "days", out: str = "date") -> DataFrame:
    """Weekly dates ``end - days, end - days + 7, …`` strictly before ``end``."""
    n = history_days(F.col(days))
    first = F.date_sub(F.col(end), n)
    return df.withColumn(out, F.explode(_weekly(first, F.date_sub(F.col(end), 1))))
