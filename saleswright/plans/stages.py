"""Stages from raw files to features, with their counts taken in the job that writes them.

The counts are observations inside the plan of the write: no second pass over the data. They come from the attempt of
each task that succeeded, so a lost executor does not count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import DEFAULT_HORIZON
from ..operators.clean import assert_no_nulls, clip_negative
from ..operators.enrich import enrich
from ..sources.stages import write_stage
from .features import build_feature_matrix

REQUIRED = ("date", "store_nbr", "family", "sales")
FAIL, DROP, KEEP = "fail", "drop", "keep"


def _null_counts(cols: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]


def write_clean_sales(sales: DataFrame, path: str, required: Sequence[str] = REQUIRED, nulls: str = FAIL, partition_by: Sequence[str] = ()) -> dict:
    """Guard, count, clip and write raw sales in one job; the counts of that job.

    n_rows, n_negative, first and last date and the nulls of each required column are those of the raw rows, n_written is
    what the stage holds. ``nulls``: the job fails on the first null in a required column (``fail``, and nothing is left in
    place of the stage), or such rows are left out (``drop``) or stay (``keep``). Negative sales become 0.
    """
    if nulls not in (FAIL, DROP, KEEP):
        raise ValueError(f"nulls is one of {FAIL}, {DROP}, {KEEP}, not {nulls}")
    raw, written = Observation("raw"), Observation("written")
    counted = sales.observe(
        raw, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("sales") < 0).alias("n_negative"),
        F.min("date").alias("first"), F.max("date").alias("last"), *_null_counts(required))
    if nulls == FAIL:
        counted = assert_no_nulls(counted, required)
    elif nulls == DROP:
        counted = counted.dropna(subset=list(required))
    clean = clip_negative(counted).observe(written, F.count(F.lit(1)).alias("n_written"))
    write_stage(clean, path, partition_by)
    return {**raw.get, **written.get}


def write_features(
    clean: DataFrame, external: dict[str, DataFrame], path: str, horizon: int = DEFAULT_HORIZON, partition_by: Sequence[str] = (), **plan
) -> dict:
    """Join, window and write the feature matrix in one job: n_rows before and n_dropped by the warm-up rule, n_written.

    ``plan`` goes to :func:`~saleswright.plans.features.build_feature_matrix`.
    """
    warm, written = Observation("warm_up"), Observation("features")
    matrix = build_feature_matrix(enrich(clean, external), horizon, counted=warm, **plan)
    write_stage(matrix.observe(written, F.count(F.lit(1)).alias("n_written")), path, partition_by)
    return {**warm.get, **written.get}
