"""Lags and rolling statistics by calendar day, for series with days that have no row.

Frames are ranges over day numbers, so a day that has no row takes its place without being written. What such a
day counts as is the caller's choice:

``zero``  it counts 0, as a shop that sold nothing: a window of n days always has n values;
``skip``  it is unknown: statistics are those of the days that have a value, and a lag to it is null.

A row with a null value is a day without value. Values are null until the series has begun n days before. Series
have one row a day (see :func:`~saleswright.operators.windows.daily_fact`). All frames share one order of one
partitioning: one shuffle, one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .windows import SERIES

ZERO, SKIP = "zero", "skip"


def _days(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(order).cast("date")))


def _known(keys: Sequence[str], order: str, n: int, since: str | None) -> Column:
    """Whether the series has begun n days before a row or earlier."""
    first = F.col(since) if since else F.min(F.col(order)).over(_days(keys, order).rangeBetween(Window.unboundedPreceding, 0))
    return F.datediff(order, first) >= n


def _checked(absent: str) -> str:
    if absent not in (ZERO, SKIP):
        raise ValueError(f"a day without a row counts as {ZERO!r} or {SKIP!r}, not {absent!r}")
    return absent


def calendar_lags(
    target: str, lags: Sequence[int], keys: Sequence[str] = SERIES, order: str = "date", absent: str = ZERO, since: str | None = None
) -> dict[str, Column]:
    """The value exactly k days before, as columns ``{target}_lag_{k}``."""
    out = {}
    for k in dict.fromkeys(lags):
        value = F.max(target).over(_days(keys, order).rangeBetween(-k, -k))
        if _checked(absent) == ZERO:
            value = F.when(_known(keys, order, k, since), F.coalesce(value, F.lit(0).cast("double")))
        out[f"{target}_lag_{k}"] = value
    return out


def calendar_rolling(
    target: str, windows: Sequence[int], keys: Sequence[str] = SERIES, order: str = "date", absent: str = ZERO, since: str | None = None
) -> dict[str, Column]:
    """Mean and sample deviation of the n days before a row, as ``{target}_rolling_mean_{n}`` and ``…_std_{n}``.

    With z days that count 0 beside c values of mean m and squared deviations M2, the mean is m·c/n and the squared
    deviations are M2 + m²·c·z/n: no sum of squares that could cancel.
    """
    out = {}
    for n in dict.fromkeys(windows):
        frame = _days(keys, order).rangeBetween(-n, -1)
        mean, full = F.avg(target).over(frame), _known(keys, order, n, since)
        if _checked(absent) == ZERO:
            c, m = F.count(target).over(frame), F.coalesce(mean, F.lit(0.0))
            squares = F.coalesce(F.var_pop(target).over(frame), F.lit(0.0)) * c + m * m * c * (n - c) / n
            mean, std = m * c / n, F.sqrt(F.try_divide(squares, F.lit(float(n - 1))))
        else:
            std = F.stddev_samp(target).over(frame)
        out[f"{target}_rolling_mean_{n}"], out[f"{target}_rolling_std_{n}"] = F.when(full, mean), F.when(full, std)
    return out


def calendar_promotions(keys: Sequence[str] = SERIES, order: str = "date", n: int = 7, since: str | None = None) -> dict[str, Column]:
    """Promotions of the n days before, 0 until known; a day without a row has none."""
    total = F.coalesce(F.sum("onpromotion").over(_days(keys, order).rangeBetween(-n, -1)), F.lit(0))
    return {f"promo_rolling_{n}": F.when(_known(keys, order, n, since), total).otherwise(F.lit(0)), "onpromotion": F.coalesce("onpromotion", F.lit(0))}


def with_start(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "date", name: str = "_since") -> DataFrame:
    """The first day of each series beside its rows, for windows over a part of a series."""
    return df.join(df.groupBy(*keys).agg(F.min(order).alias(name)), list(keys))
