"""Leakage-free lags and rolling statistics per series.

Offsets count rows of a series, not calendar days. A series has one row per day (see
:func:`daily_fact`), so its window holds at most as many rows as the calendar has days. Where that is
still too much for one task, :func:`in_year_blocks` computes the same windows in yearly blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.numbers import pct_change

SERIES = ("store_nbr", "family")


def daily_fact(
    df: DataFrame, keys: Sequence[str] = SERIES, date: str = "date", sums: Sequence[str] = ("sales",), firsts: Sequence[str] = ()
) -> DataFrame:
    """One row per series and day. Sums combine before the shuffle, so a hot series stays small.

    ``firsts`` are columns that agree on all rows of a series and day."""
    return df.groupBy(date, *keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.first(c).alias(c) for c in firsts])


def _ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _before(keys: Sequence[str], order: str, n: int) -> WindowSpec:
    return _ordered(keys, order).rowsBetween(-n, -1)


def _full(count_of: Column, frame: WindowSpec, n: int, value: Column) -> Column:
    """``value`` once the frame holds n non-null rows."""
    return F.when(F.count(count_of).over(frame) == n, value)


def lag_columns(target: str, lags: Sequence[int], keys: Sequence[str] = SERIES, order: str = "date") -> dict[str, Column]:
    w = _ordered(keys, order)
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in dict.fromkeys(lags)}


def add_rolling(
    df: DataFrame, keys: Sequence[str] = SERIES, target: str = "sales", windows: Sequence[int] = (7, 14, 28, 90), order: str = "date"
) -> DataFrame:
    """Mean and sample deviation of the n rows before the current one, for several n.

    A frame that slides is computed anew for every row, so a row would cost the sum of all window
    lengths. Here only the shortest window slides; a longer one is put together from lagged results of
    the one before (and a short remainder), with the parallel formula for means and squared deviations:

        mean = Σ nᵢ·meanᵢ / n        M2 = Σ M2ᵢ + Σ nᵢ·(meanᵢ − mean)²

    A part is null unless its frame is full, and so is everything built on it. All steps share the
    partitioning and order of the series: one shuffle and one sort.
    """
    series, y = _ordered(keys, order), F.col(target)
    wanted = list(dict.fromkeys(windows))
    helpers: list[str] = []

    def sliding(first: int, last: int) -> tuple[Column, Column]:
        """Mean and squared deviations of the rows from ``last`` to ``first`` rows back."""
        frame, n = series.rowsBetween(-last, -first), last - first + 1
        return _full(y, frame, n, F.avg(y).over(frame)), _full(y, frame, n, F.var_pop(y).over(frame)) * n

    previous = 0
    for n in sorted(wanted):
        blocks = n // previous if previous else 0
        rest = n - blocks * previous
        parts = [(previous, F.lag(f"_mean_{previous}", i * previous).over(series), F.lag(f"_m2_{previous}", i * previous).over(series)) if i
                 else (previous, F.col(f"_mean_{previous}"), F.col(f"_m2_{previous}")) for i in range(blocks)]
        if rest:
            parts.append((rest, *sliding(blocks * previous + 1, n)))
        names = [(size, f"_mean_{n}_{i}", f"_m2_{n}_{i}") for i, (size, _, _) in enumerate(parts)]
        df = df.withColumns({name: c for (_, a, b), (_, ca, cb) in zip(names, parts) for name, c in ((a, ca), (b, cb))})
        mean = sum((F.col(a) * size for size, a, _ in names[1:]), F.col(names[0][1]) * names[0][0]) / n
        df = df.withColumn(f"_mean_{n}", mean)
        gaps = [F.col(b) + (F.col(a) - F.col(f"_mean_{n}")) * (F.col(a) - F.col(f"_mean_{n}")) * size for size, a, b in names]
        df = df.withColumn(f"_m2_{n}", sum(gaps[1:], gaps[0]))
        helpers += [f"_mean_{n}", f"_m2_{n}", *[c for _, a, b in names for c in (a, b)]]
        previous = n
    return df.withColumns(
        {
            column: value
            for n in wanted
            for column, value in (
                (f"{target}_rolling_mean_{n}", F.col(f"_mean_{n}")),
                (f"{target}_rolling_std_{n}", F.sqrt(F.try_divide(F.col(f"_m2_{n}"), F.lit(float(n - 1))))),
            )
        }
    ).drop(*helpers)


def promo_columns(keys: Sequence[str] = SERIES, order: str = "date", n: int = 7) -> dict[str, Column]:
    """Promotions of the n rows before, 0 until known. The sum sees the column before its nulls are filled."""
    raw = F.col("onpromotion")
    frame = _before(keys, order, n)
    return {
        f"promo_rolling_{n}": F.coalesce(_full(raw, frame, n, F.sum(raw).over(frame)), F.lit(0)),
        "onpromotion": F.coalesce(raw, F.lit(0)),
    }


def add_lags(df: DataFrame, keys: Sequence[str] = SERIES, target: str = "sales", lags: Sequence[int] = (1, 7, 14, 28, 90), order: str = "date") -> DataFrame:
    return df.withColumns(lag_columns(target, lags, keys, order))


def promo_features(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    return df.withColumns(promo_columns(keys, order)) if "onpromotion" in df.columns else df


BLOCK = "_block"


def in_year_blocks(
    df: DataFrame,
    reach: int,
    compute: Callable[[DataFrame, Sequence[str]], DataFrame],
    keys: Sequence[str] = SERIES,
    order: str = "date",
) -> DataFrame:
    """Run a backward-looking window computation block by block; same result, bounded tasks.

    Every row goes to the block of its year. The last ``reach`` rows before a block are copied into it,
    from as many earlier years as that takes, so a window of up to ``reach`` rows finds all it needs.
    ``compute(df, keys)`` gets the extended keys; copied rows are removed from its result.
    """
    year = F.year(order)
    counts = df.groupBy(*keys, year.alias("_year")).agg(F.count(F.lit(1)).alias("_rows"))
    later = Window.partitionBy(*keys).orderBy("_year").rowsBetween(1, Window.unboundedFollowing)
    # For each year: the later years, with the number of rows that lie in between.
    followers = counts.withColumn("_later", F.collect_list(F.struct("_year", "_rows")).over(later)).select(
        *keys,
        "_year",
        F.expr(
            "transform(_later, (z, i) -> struct(z._year as _year,"
            " aggregate(slice(_later, 1, i), 0L, (n, u) -> n + u._rows) as _between))"
        ).alias("_later"),
    )
    from_end = F.row_number().over(Window.partitionBy(*keys, "_year").orderBy(F.desc(order)))
    placed = (
        df.withColumn("_year", year)
        .withColumn("_from_end", from_end)
        .join(followers, [*keys, "_year"])
        .withColumn(
            BLOCK,
            F.explode(
                F.concat(
                    F.array("_year"),
                    F.transform(
                        F.filter("_later", lambda z: z["_between"] + F.col("_from_end") <= reach),
                        lambda z: z["_year"],
                    ),
                )
            ),
        )
        .drop("_year", "_from_end", "_later")
    )
    return compute(placed, [*keys, BLOCK]).where(F.col(BLOCK) == year).drop(BLOCK)


def with_trend(df: DataFrame, node: Sequence[str], period: str, value: str = "prediction") -> DataFrame:
    """Value of the previous period of the same node, and the percent change against it."""
    previous = F.lag(value).over(Window.partitionBy(*node).orderBy(period))
    return df.withColumn(f"previous_{value}", previous).withColumn(
        "trend_percent", pct_change(F.col(value), F.col(f"previous_{value}"))
    )


def share_of_parent(df: DataFrame, parent: Sequence[str], value: str = "prediction", out: str = "share_percent") -> DataFrame:
    """Percent of the parent's sum; null for a sum of 0.

    The sums are aggregated first and joined back, so a parent with very many children does not have
    to fit one task.
    """
    totals = df.groupBy(*parent).agg(F.sum(value).alias("_parent_sum"))
    share = F.try_divide(F.col(value), F.nullif("_parent_sum", F.lit(0))) * 100
    return df.join(totals, list(parent)).withColumn(out, share).drop("_parent_sum")


def thin(daily: DataFrame, size: int, order: str = "date") -> DataFrame:
    """Every n-th row, n = rows // size; may return more than ``size`` rows, as the floor implies.

    Works on a daily aggregate, hence on one row per calendar day.
    """
    numbered = daily.withColumns(
        {
            "_row": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1,
            "_all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))),
        }
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / size))
    return numbered.where(F.col("_row") % step == 0).drop("_row", "_all")
