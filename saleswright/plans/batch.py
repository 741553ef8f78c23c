"""Batch prediction: validate, look up features, score, attach bands; failures stay as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FAMILIES, MAX_STORE
from ..operators.intervals import BANDS, apply_intervals
from ..operators.requests import lookup_features, validate_requests
from ..sources.files import read_requests, write_batch_results
from ..sources.stages import materialised

RESULT = ("row_id", "store_nbr", "family", "date", "horizon", "prediction", *BANDS, "source", "status", "error")


def batch_predict(
    requests: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    offsets: DataFrame,
    families: Sequence[str] | Column = FAMILIES,
    max_store: int | None = None,
) -> DataFrame:
    """One result row per request. ``score`` adds ``prediction`` to rows that hold ``columns``."""
    checked = validate_requests(requests, families, max_store)
    valid = checked.where(F.col("code").isNull()).withColumn("date", F.to_date("date", "yyyy-MM-dd"))
    predicted = apply_intervals(score(lookup_features(valid, features, columns)), offsets)
    done = predicted.withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string")})
    failed = checked.where(F.col("code").isNotNull()).withColumns({"status": F.lit("error"), "error": F.col("message")})
    return done.withColumn("date", F.col("date").cast("string")).select(*RESULT).unionByName(
        failed.select(*[c for c in RESULT if c in failed.columns]), allowMissingColumns=True
    )


def batch_predict_files(
    spark: SparkSession, source: str, target: str, features: DataFrame, columns: Sequence[str],
    score: Callable[[DataFrame], DataFrame], offsets: DataFrame, families: Sequence[str] | Column = FAMILIES, max_store: int = MAX_STORE,
) -> DataFrame:
    """Requests from CSV files to a CSV of the results that succeeded; returns all results, failures as rows.

    Stores beyond ``max_store`` are invalid on this path.
    """
    results = materialised(batch_predict(read_requests(spark, source), features, columns, score, offsets, families, max_store), "batch_results")
    write_batch_results(results, target)
    return results
