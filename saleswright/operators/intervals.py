"""Prediction bands from residual quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BAND_PERCENTILES
from ..functions.numbers import floor_zero
from .facts import exact_quantiles

BANDS = ("lower_80", "upper_80", "lower_95", "upper_95")


def interval_offsets(df: DataFrame, y: str = "y", p: str = "y_hat") -> DataFrame:
    """One row: residual percentiles, population deviation, mean absolute error, number of residuals."""
    residuals = df.select((F.col(y) - F.col(p)).alias("residual"))
    spread = residuals.agg(
        F.stddev_pop("residual").alias("std"),
        F.avg(F.abs("residual")).alias("mean_abs_error"),
        F.count("residual").alias("n_samples"),
    )
    offsets = exact_quantiles(residuals, "residual", BAND_PERCENTILES)
    row = offsets.select(F.struct(*BAND_PERCENTILES)).scalar()
    return spread.withColumn("_offsets", row).select("_offsets.*", "std", "mean_abs_error", "n_samples")


def band_columns(prediction: Column, offsets: Column) -> dict[str, Column]:
    """Bands as columns; lower bounds do not go below 0, and absent offsets give null bands."""
    return {
        band: floor_zero(prediction + offsets[f"{band}_offset"])
        if band.startswith("lower")
        else prediction + offsets[f"{band}_offset"]
        for band in BANDS
    }


def apply_intervals(df: DataFrame, offsets: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Attach bands to every row. The single offsets row enters as a literal, not as a join."""
    row = offsets.select(F.struct(*BAND_PERCENTILES)).scalar()
    return (
        df.withColumn("_offsets", row)
        .withColumns(band_columns(F.col(prediction), F.col("_offsets")))
        .drop("_offsets")
    )


def fallback_band(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """±10 % and ±15 % where there is no band; a band is missing if its 80 % floor is null or 0."""
    p = F.col(prediction)
    spread = {"80": 0.10, "95": 0.15}
    have = F.col("lower_80").isNotNull() & (F.col("lower_80") != 0)
    filled = {}
    for level, share in spread.items():
        filled[f"lower_{level}"] = F.when(have, F.col(f"lower_{level}")).otherwise(F.greatest(F.lit(0.0), p - p * share))
        filled[f"upper_{level}"] = F.when(have, F.col(f"upper_{level}")).otherwise(p + p * share)
    return df.withColumns(filled)
