"""The feature matrix: dates, promotions, series id, lags, rolling statistics, warm-up drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import DEFAULT_HORIZON, LAGS, WINDOWS
from ..functions.dates import date_features
from ..functions.text import series_id
from ..operators.calendar import calendar_lags, calendar_promotions, calendar_rolling, with_start
from ..operators.clean import drop_warmup
from ..operators.windows import SERIES, add_rolling, daily_fact, in_year_blocks, lag_columns, promo_columns


def window_features(df: DataFrame, horizon: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """All window columns. Equal keys and order throughout, hence one shuffle and one sort."""
    columns = lag_columns("sales", (*LAGS[:-1], horizon), keys)
    if "onpromotion" in df.columns:
        columns |= promo_columns(keys)
    return add_rolling(df.withColumns(columns), keys, "sales", (*WINDOWS[:-1], horizon))


def calendar_features(df: DataFrame, horizon: int, absent: str, keys: Sequence[str] = SERIES, since: str | None = None) -> DataFrame:
    """The same columns by calendar day: a day without a row counts as ``absent`` says."""
    columns = calendar_lags("sales", (*LAGS[:-1], horizon), keys, absent=absent, since=since)
    columns |= calendar_rolling("sales", (*WINDOWS[:-1], horizon), keys, absent=absent, since=since)
    if "onpromotion" in df.columns:
        columns |= calendar_promotions(keys, since=since)
    return df.withColumns(columns)


def build_feature_matrix(
    df: DataFrame, horizon: int = DEFAULT_HORIZON, year_blocks: bool = False, calendar: str | None = None, merge_days: bool = False,
    counted: Observation | None = None,
) -> DataFrame:
    """Feature matrix of a fact with one row per series and day.

    ``merge_days`` first adds up the rows of a series and day, for facts that have many; combined before the
    shuffle. ``year_blocks`` splits long series over tasks at the price of a second shuffle. ``calendar`` makes windows and lags go by day
    instead of by row; it says what a day without a row counts as, ``zero`` or ``skip``. Rows without the longest lag go;
    ``counted`` observes n_rows and n_dropped of that rule.
    """
    if merge_days:
        sums = [c for c in ("sales", "onpromotion") if c in df.columns]
        beside = [c for c in df.columns if c not in (*sums, *SERIES, "date")]
        df = daily_fact(df, sums=sums, firsts=beside).select(*df.columns)
    reach = max(horizon, *LAGS[:-1], *WINDOWS[:-1])
    if calendar and year_blocks:
        started = with_start(df)
        windowed = in_year_blocks(started, reach, lambda part, keys: calendar_features(part, horizon, calendar, keys, "_since")).drop("_since")
    elif calendar:
        windowed = calendar_features(df, horizon, calendar)
    elif year_blocks:
        windowed = in_year_blocks(df, reach, lambda part, keys: window_features(part, horizon, keys))
    else:
        windowed = window_features(df, horizon)
    if counted:
        windowed = windowed.observe(counted, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"sales_lag_{horizon}").isNull()).alias("n_dropped"))
    kept = drop_warmup(windowed, horizon)
    return date_features(kept).withColumn("unique_id", series_id(F.col("store_nbr"), F.col("family")))
