"""Per-series forecasters: seasonal naive and simple exponential smoothing.

A training set may hold many folds or cutoffs at once; ``by`` names the columns that tell models apart.
Series have one row per day, so an ordered array of a series is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import LEVEL_Z
from .split import TRAIN, VALID

SEASON = 7
ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def _steps(h: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(h)))


def last_season(train: DataFrame, by: Sequence[str] = ("unique_id",), m: int = SEASON, absent: str | None = None) -> DataFrame:
    """The last known value of each phase of the season, and the last date of each series.

    ``season`` stands for the m days up to the last date, oldest first. A day that is missing there takes the
    latest value of its phase, so gaps do not shift weekdays; with ``absent`` it is taken as it stands in the
    calendar, 0 for ``zero`` and null for ``skip``. Series that do not hold every phase are left out, by the
    calendar those that began less than m days before their last date. Two aggregates, both combined before the
    shuffle; no order over a series.
    """
    if absent:
        recent = train.groupBy(*by).agg(F.max("ds").alias("last_ds"), F.min("ds").alias("_first"))
        recent = recent.where(F.datediff("last_ds", "_first") >= m - 1)
        back = F.datediff("last_ds", "ds")
        days = train.join(recent.drop("_first"), list(by)).where(back < m).groupBy(*by, "last_ds").agg(
            F.map_from_entries(F.collect_list(F.struct(back, "y"))).alias("_known"))
        value = lambda i: F.try_element_at("_known", F.lit(m - 1) - i)
        held = (lambda i: F.coalesce(value(i), F.lit(0.0))) if absent == "zero" else value
        return days.select(*by, "last_ds", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), held).alias("season"))
    phase = F.pmod(F.unix_date(F.col("ds").cast("date")), F.lit(m))
    known = train.groupBy(*by, phase.alias("_phase")).agg(F.max("ds").alias("_ds"), F.max_by("y", "ds").alias("y"))
    series = known.groupBy(*by).agg(
        F.max("_ds").alias("last_ds"), F.map_from_entries(F.collect_list(F.struct("_phase", "y"))).alias("_known"))
    day = lambda i: F.pmod(F.unix_date(F.col("last_ds").cast("date")) - (m - 1) + i, F.lit(m))
    season = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.element_at("_known", day(i)))
    return series.where(F.size("_known") == m).select(*by, "last_ds", season.alias("season"))


def _phase(step: Column, m: int) -> Column:
    """Value of ``season`` for the step-th period ahead."""
    return F.element_at("season", (F.pmod(step - 1, F.lit(m)) + 1).cast("int"))


def seasonal_naive(train: DataFrame, h: int, m: int = SEASON, by: Sequence[str] = ("unique_id",), absent: str | None = None) -> DataFrame:
    """Repeat the last season for h steps. Series shorter than a season have no forecast; see :func:`last_season` for ``absent``."""
    return (
        last_season(train, by, m, absent)
        .withColumn("step", _steps(h))
        .select(*by, F.date_add("last_ds", F.col("step")).alias("ds"), "step", _phase(F.col("step"), m).alias("y_hat"))
    )


def naive_forecaster(m: int = SEASON):
    """Seasonal naive as a model of the cross-validation: each valid row is looked up by its days ahead."""

    def predict(rows: DataFrame) -> DataFrame:
        by = ["fold", "unique_id"]
        seasons = last_season(rows.where(F.col("role") == TRAIN), by, m)
        valid = rows.where(F.col("role") == VALID).select(*by, "ds", "y")
        ahead = F.datediff("ds", "last_ds")
        return valid.join(seasons, by).select(*by, "ds", "y", _phase(ahead, m).alias("y_hat"))

    return predict


def residual_sigma(train: DataFrame, m: int = SEASON, by: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Root mean square of the in-sample errors of the seasonal naive forecast."""
    error = F.col("y") - F.lag("y", m).over(Window.partitionBy(*by).orderBy("ds"))
    return train.select(*by, error.alias("_e")).groupBy(*by).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("sigma"))


def smooth(train: DataFrame, by: Sequence[str] = ("unique_id",), alphas: Sequence[float] = ALPHAS, m: int | None = None) -> DataFrame:
    """Exponential smoothing: per series the level of the α with the smallest one-step squared error.

    With ``m``, additive indices per position in the season are taken off first. ``season`` then holds
    the m indices in order of the periods after ``last_ds``; without it, a single 0.
    """
    series = train.groupBy(*by).agg(
        F.max("ds").alias("last_ds"), F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("_rows")
    ).select(*by, "last_ds", F.transform("_rows", lambda r: r["y"]).alias("_y"))
    if m is None:
        series = series.withColumns({"season": F.array(F.lit(0.0)), "_adj": F.col("_y")})
    else:
        # Index of the phase that follows the last row by 1 … m periods, counted backwards from it.
        series = series.where(F.size("_y") >= m).withColumn("season", F.expr(f"""
            transform(sequence(1, {m}), k ->
              aggregate(
                filter(_y, (v, i) -> pmod(size(_y) - 1 - i, {m}) = pmod(-k, {m})),
                named_struct('s', 0D, 'n', 0),
                (a, v) -> named_struct('s', a.s + v, 'n', a.n + 1),
                a -> a.s / a.n)
              - aggregate(_y, 0D, (a, v) -> a + v) / size(_y))"""))
        series = series.withColumn("_adj", F.expr(
            f"transform(_y, (v, i) -> v - element_at(season, int(pmod(i - size(_y), {m}) + 1)))"))
    # One pass over the values per α, starting at the first value; all within the row of the series.
    grid = ", ".join(f"{float(a)!r}D" for a in alphas)
    fits = F.expr(f"""
        transform(array({grid}), a -> named_struct('alpha', a, 'fit',
          aggregate(
            slice(_adj, 2, size(_adj)),
            named_struct('level', _adj[0], 'sse', 0D),
            (s, v) -> named_struct(
              'level', s.level + a * (v - s.level),
              'sse', s.sse + (v - s.level) * (v - s.level)))))""")
    best = F.array_min(F.transform("_fits", lambda f: F.struct(f["fit"]["sse"].alias("sse"), f["alpha"].alias("alpha"), f["fit"]["level"].alias("level"))))
    return series.withColumn("_fits", fits).withColumn("_b", best).select(
        *by, "last_ds", "_b.alpha", "_b.level", "_b.sse", "season", F.size("_adj").alias("n_obs")
    )


def ets(train: DataFrame, h: int, m: int | None = None, by: Sequence[str] = ("unique_id",), alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Flat (or, with ``m``, seasonal-index) forecast of the smoothed level for h steps."""
    fitted = smooth(train, by, alphas, m).withColumn("step", _steps(h))
    index = F.element_at("season", (F.pmod(F.col("step") - 1, F.size("season")) + 1).cast("int"))
    return fitted.select(
        *by, F.date_add("last_ds", F.col("step")).alias("ds"), "step", (F.col("level") + index).alias("y_hat"),
        "alpha", F.sqrt(F.try_divide(F.col("sse"), F.col("n_obs") - 1)).alias("sigma"),
    )


def ets_forecaster(m: int | None = None, alphas: Sequence[float] = ALPHAS):
    def predict(rows: DataFrame) -> DataFrame:
        by = ["fold", "unique_id"]
        fitted = smooth(rows.where(F.col("role") == TRAIN), by, alphas, m)
        valid = rows.where(F.col("role") == VALID).select(*by, "ds", "y")
        ahead = F.datediff("ds", "last_ds")
        index = F.element_at("season", (F.pmod(ahead - 1, F.size("season")) + 1).cast("int"))
        return valid.join(fitted, by).select(*by, "ds", "y", (F.col("level") + index).alias("y_hat"))

    return predict


def forecast_all(train: DataFrame, h: int, levels: Sequence[int] = (80, 95), m: int = SEASON, models: Sequence[str] = ("SeasonalNaive", "ETS")) -> DataFrame:
    """All series and models at once, a row per band level: model, unique_id, ds, y_hat, level, lo, hi.

    The naive band widens with each season ahead, the smoothed one with each step.
    """
    parts = []
    if "SeasonalNaive" in models:
        naive = seasonal_naive(train, h, m).join(residual_sigma(train, m), "unique_id")
        seasons_ahead = F.floor((F.col("step") - 1) / m) + 1
        parts.append(naive.select(F.lit("SeasonalNaive").alias("model"), "unique_id", "ds", "y_hat",
                                  (F.col("sigma") * F.sqrt(seasons_ahead)).alias("_se")))
    if "ETS" in models:
        growth = F.sqrt(1 + (F.col("step") - 1) * F.col("alpha") * F.col("alpha"))
        parts.append(ets(train, h, m).select(F.lit("ETS").alias("model"), "unique_id", "ds", "y_hat",
                                             (F.col("sigma") * growth).alias("_se")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bands = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(LEVEL_Z[lv]).alias("z")) for lv in levels])
    return out.withColumn("_band", F.explode(bands)).select(
        "model", "unique_id", "ds", "y_hat", "_band.level",
        (F.col("y_hat") - F.col("_band.z") * F.col("_se")).alias("lo"),
        (F.col("y_hat") + F.col("_band.z") * F.col("_se")).alias("hi"),
    )


def rolling_origin(series: DataFrame, h: int, windows: int, step: int) -> DataFrame:
    """Fold rows per series and cutoff: ``fold`` 1 is the earliest cutoff, the last one leaves h days.

    Cutoffs count back from the last date of each series. Rows up to the cutoff train, the next h days
    are valid.
    """
    ends = series.groupBy("unique_id").agg(F.max("ds").alias("_end"))
    cutoffs = F.transform(
        F.sequence(F.lit(1), F.lit(windows)),
        lambda i: F.struct(i.alias("fold"), F.date_sub(F.col("_end"), F.lit(h) + (F.lit(windows) - i) * step).alias("cutoff")),
    )
    placed = series.join(ends, "unique_id").withColumn("_c", F.explode(cutoffs))
    role = F.when(F.col("ds") <= F.col("_c.cutoff"), TRAIN).when(
        F.col("ds") <= F.date_add(F.col("_c.cutoff"), h), VALID
    )
    return placed.select("unique_id", "ds", "y", F.col("_c.fold").alias("fold"), F.col("_c.cutoff").alias("cutoff"), role.alias("role")).where(
        F.col("role").isNotNull()
    )


def cv_series(series: DataFrame, model, h: int, windows: int = 3, step: int = 30) -> DataFrame:
    """Rolling-origin forecasts next to the actual values: fold, unique_id, ds, y, y_hat."""
    return model(rolling_origin(series, h, windows, step))
