"""What-if: change features by name, score again, report the difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct_change
from .linear import LinearModel

# Names an adjustment may use, and the feature column each one stands for.
ADJUSTABLE = {
    "oil_price": "oil_price",
    "onpromotion": "onpromotion",
    "day_of_week": "dayofweek",
    "day_of_month": "day",
    "month": "month",
    "year": "year",
    "sales_lag_7": "sales_lag_7",
    "sales_lag_14": "sales_lag_14",
    "sales_lag_28": "sales_lag_28",
    "sales_lag_90": "sales_lag_90",
    "rolling_mean_7": "sales_rolling_mean_7",
    "rolling_mean_28": "sales_rolling_mean_28",
    "rolling_std_7": "sales_rolling_std_7",
    "rolling_std_28": "sales_rolling_std_28",
    "day_of_year": "dayofyear",
    "is_mid_month": "is_mid_month",
    "is_leap_year": "is_leap_year",
    "sales_rolling_mean_14": "sales_rolling_mean_14",
    "sales_rolling_mean_90": "sales_rolling_mean_90",
    "sales_rolling_std_14": "sales_rolling_std_14",
    "sales_rolling_std_90": "sales_rolling_std_90",
    "cluster": "cluster",
    "family_encoded": "family_encoded",
    "type_encoded": "type_encoded",
}

# Slider ranges of the sensitivity grid.
OIL_STEPS = tuple(round(0.5 + 0.1 * i, 1) for i in range(16))
PROMOTION_STEPS = (0.0, 1.0)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def adjusted(name: str, value: Column, adjustment: Column, reference_bounds: bool = False) -> Column:
    """New value of a feature: flags are set, weekday and month replaced within bounds, others scaled.

    Weekdays are ISO 1–7; ``reference_bounds`` clamps them to 0–6 instead.
    """
    if name == "onpromotion":
        return F.when(adjustment > 0.5, 1.0).otherwise(0.0)
    if name == "day_of_week":
        return _clamp(adjustment, *((0.0, 6.0) if reference_bounds else (1.0, 7.0)))
    if name == "month":
        return _clamp(adjustment, 1.0, 12.0)
    return value * adjustment


def what_if(
    df: DataFrame, model: LinearModel, adjustments: str = "adjustments", reference_bounds: bool = False
) -> DataFrame:
    """Add original, adjusted, delta, delta_pct, applied (map) and skipped (names) to each row.

    ``adjustments`` is a map of name → number. Names that stand for no model feature are skipped.
    """
    wanted = F.col(adjustments)
    by_column = {column: name for name, column in ADJUSTABLE.items()}
    changed = []
    for f in model.features:
        x = F.col(f).cast("double")
        name = by_column.get(f)
        if name is None:
            changed.append(x)
            continue
        value = F.try_element_at(wanted, F.lit(name))
        changed.append(F.when(value.isNotNull(), adjusted(name, x, value, reference_bounds)).otherwise(x))
    known = [name for name, column in ADJUSTABLE.items() if column in model.features]
    scored = df.withColumns(
        {
            "original": model.predict(),
            "adjusted": model.predict(changed),
            "applied": F.map_filter(wanted, lambda k, v: k.isin(*known) & v.isNotNull()),
            "skipped": F.array_sort(F.filter(F.map_keys(wanted), lambda k: ~k.isin(*known))),
        }
    )
    return scored.withColumns(
        {"delta": F.col("adjusted") - F.col("original"), "delta_pct": pct_change(F.col("adjusted"), F.col("original"))}
    )


def sensitivity_grid(weekdays: Sequence[int] = (1, 2, 3, 4, 5, 6, 7)) -> list[tuple[str, float]]:
    return (
        [("oil_price", v) for v in OIL_STEPS]
        + [("onpromotion", v) for v in PROMOTION_STEPS]
        + [("day_of_week", float(v)) for v in weekdays]
    )


def sensitivity(df: DataFrame, model: LinearModel, grid: Sequence[tuple[str, float]] | None = None) -> DataFrame:
    """What-if for every row and grid point: adds ``adjust`` and ``amount``. The grid is a literal array."""
    points = F.array(
        *[F.struct(F.lit(n).alias("adjust"), F.lit(float(v)).alias("amount")) for n, v in grid or sensitivity_grid()]
    )
    spread = df.select("*", F.inline(points)).withColumn("_adj", F.create_map("adjust", "amount"))
    return what_if(spread, model, "_adj").drop("_adj", "applied", "skipped")
