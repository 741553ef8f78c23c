"""Quality gates as rows: gate, value, threshold, passed, note."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STORE, TOTAL
from ..sources.stages import path_exists


def _gate(name: str, value: Column, threshold: Column, passed: Column, note: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("gate"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        (note if note is not None else F.lit(None)).cast("string").alias("note"),
    )


def data_gates(df: DataFrame, max_null_ratio: float, min_rows: int, required: Sequence[str]) -> DataFrame:
    """Null ratio over all cells, row count and required columns, in one pass over the data."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_nulls"))
    cells = F.col("n_rows") * len(df.columns)
    ratio = F.coalesce(F.try_divide(F.col("n_nulls"), cells), F.lit(0.0))
    missing = [c for c in required if c not in df.columns]
    gates = F.array(
        _gate("data_null_ratio", ratio, F.lit(max_null_ratio), ratio < max_null_ratio),
        _gate("data_row_count", F.col("n_rows"), F.lit(min_rows), F.col("n_rows") >= min_rows),
        _gate("required_columns", F.lit(len(missing)), F.lit(0), F.lit(not missing), F.lit(",".join(missing) or None)),
    )
    return facts.select(F.inline(gates))


def model_gate(metrics: DataFrame, threshold: float) -> DataFrame:
    """RMSLE of the final model, else of the cross-validation, against a threshold; neither is a failure."""
    value = F.coalesce(F.nullif("final_rmsle", F.lit(0.0)), F.nullif("cv_rmsle", F.lit(0.0)))
    row = metrics.agg(F.max("final_rmsle").alias("final_rmsle"), F.max("cv_rmsle").alias("cv_rmsle"))
    return row.select(F.inline(F.array(_gate("model_rmsle", value, F.lit(threshold), value < threshold))))


def recon_gate(nodes: DataFrame, tolerance: float, value: str = "y_hat") -> DataFrame:
    """Relative gap between the total and the sum of the stores; without a positive total it is skipped."""
    sums = nodes.agg(
        F.sum(F.when(F.col("level") == TOTAL, F.col(value))).alias("t"),
        F.sum(F.when(F.col("level") == STORE, F.col(value))).alias("s"),
    )
    error = F.try_divide(F.abs(F.col("t") - F.coalesce("s", F.lit(0.0))), F.col("t"))
    positive = F.coalesce(F.col("t") > 0, F.lit(False))
    gate = _gate(
        "reconciliation", F.when(positive, error), F.lit(tolerance),
        F.when(positive, error < tolerance).otherwise(True),
        F.when(~positive, "total is zero, check skipped"),
    )
    return sums.select(F.inline(F.array(gate)))


def artifact_gates(spark: SparkSession, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Presence of artefacts; an optional one never fails."""
    rows = []
    for path, must in [*((p, True) for p in required), *((p, False) for p in optional)]:
        there = path_exists(spark, path)
        rows.append((f"artifact:{path.rsplit('/', 1)[-1]}", float(there), float(must), there or not must, None if there else "missing"))
    return spark.createDataFrame(rows, "gate string, value double, threshold double, passed boolean, note string")


def quality_report(*gates: DataFrame) -> DataFrame:
    """All gate rows with the overall verdict on each."""
    rows = reduce(DataFrame.unionByName, gates)
    overall = rows.agg(F.bool_and("passed")).scalar()
    return rows.withColumn("all_passed", overall)
