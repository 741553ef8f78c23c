"""Cleaning, guards, filters and projections on sales frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..functions.numbers import floor_zero
from ..functions.text import series_id


def null_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row, one null count per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def assert_no_nulls(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail the job that reads the result as soon as a row with a null turns up; no extra pass."""
    checked = {
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null value in column {c}")).cast(df.schema[c].dataType))
        for c in cols
    }
    return df.withColumns(checked)


def clip_negative(df: DataFrame, col: str = "sales") -> DataFrame:
    return df.withColumn(col, floor_zero(F.col(col)))


def negative_count(df: DataFrame, col: str = "sales") -> DataFrame:
    return df.agg(F.count_if(F.col(col) < 0).alias("n_negative"), F.count(F.lit(1)).alias("n_rows"))


def profile(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
    )


def national_holidays(holidays: DataFrame) -> DataFrame:
    """Distinct dates of national holidays, flagged 1."""
    return holidays.where(F.col("locale") == "National").select("date").distinct().withColumn("is_holiday", F.lit(1))


def fill_defaults(df: DataFrame, defaults: dict[str, Column | float | int]) -> DataFrame:
    """Replace nulls; columns that do not exist are left out."""
    present = {c: v for c, v in defaults.items() if c in df.columns}
    return df.withColumns(
        {c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in present.items()}
    )


def drop_warmup(df: DataFrame, horizon: int, target: str = "sales") -> DataFrame:
    """Keep rows whose longest lag exists."""
    return df.where(F.col(f"{target}_lag_{horizon}").isNotNull())


def warmup_counts(df: DataFrame, horizon: int, target: str = "sales") -> DataFrame:
    lag = F.col(f"{target}_lag_{horizon}")
    return df.agg(F.count(lag).alias("n_kept"), F.count_if(lag.isNull()).alias("n_dropped"))


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def select_features(
    df: DataFrame,
    wanted: Sequence[str] = NUMERIC_FEATURES + CATEGORICAL_FEATURES,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Project on the wanted features that exist, next to ``keep``; also say which ones are missing."""
    missing = missing_columns(df, wanted)
    return df.select(*keep, *[c for c in wanted if c not in missing]), missing


def to_series(df: DataFrame, target: str = "sales", date: str = "date") -> DataFrame:
    """unique_id, ds, y."""
    uid = F.col("unique_id") if "unique_id" in df.columns else series_id(F.col("store_nbr"), F.col("family"))
    return df.select(uid.alias("unique_id"), F.col(date).alias("ds"), F.col(target).alias("y"))
