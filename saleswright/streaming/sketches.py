"""Quantiles and distinct counts from sketches: kept per window and group, merged later without the events.

A sketch has a bounded size whatever it has seen, and merging is exact in the sense that the bounds below hold for the
merged sketch as well. So windows can be stored once and days, groups or the whole be read from them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slo import windowed

#: Items of a quantile sketch, and log2 of the registers of a distinct-count sketch.
K, LOG2_REGISTERS = 400, 12


def rank_error(k: int = K) -> float:
    """Bound of the rank error of one quantile, at 99 % confidence: the published fit for these sketches."""
    return 2.296 / k ** 0.9723


def distinct_error(log2_registers: int = LOG2_REGISTERS, deviations: float = 3.0) -> float:
    """Relative error of a distinct count at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << log2_registers)


def window_sketches(
    events: DataFrame, value: str, distinct: str, by: Sequence[str] = (), width: str = "1 hour", late: str | None = None,
    k: int = K, log2_registers: int = LOG2_REGISTERS,
) -> DataFrame:
    """window_start, window_end, by…, n, quantiles and members: a row of sketches for each window and group, batch or stream.

    Null values are in neither sketch; n counts the values that are not null."""
    return windowed(events, {
        "n": F.count(value),
        "quantiles": F.kll_sketch_agg_double(F.col(value).cast("double"), k),
        "members": F.hll_sketch_agg(distinct, log2_registers),
    }, by, width, late=late)


def merged(sketches: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """The sketches of coarser groups: by…, n, quantiles, members. Partial merges happen before the shuffle."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("members").alias("members"))


def quantiles_of(sketches: DataFrame, qs: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """keep…, n, q and value: a row a quantile. A sketch without values has none."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("quantiles", F.lit(q)).alias("value")) for q in qs]))
    return sketches.where(F.col("n") > 0).select(*keep, "n", each.alias("_q")).select(*keep, "n", "_q.q", "_q.value")


def distinct_of(sketches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return sketches.select(*keep, F.hll_sketch_estimate("members").alias("n_distinct"))


def rank_within(estimates: DataFrame, events: DataFrame, value: str, by: Sequence[str], error: float) -> DataFrame:
    """``estimates`` (by…, q, value) with the exact share of events at or below, and whether q lies within ``error`` of it.

    ``by`` is not empty; there are a few estimates a group. Values that occur often cover a range of ranks; q is within if that range comes near enough.
    """
    own = estimates.select(*by, "q", F.col("value").alias("estimate"))
    told = events.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).join(own, list(by))
    ranks = told.groupBy(*by, "q").agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("_v") <= F.col("estimate")).cast("int"))).alias("upto"),
                                      F.avg((F.col("_v") < F.col("estimate")).cast("int")).alias("below"))
    return ranks.withColumn("within", (F.col("upto") >= F.col("q") - error) & (F.col("below") <= F.col("q") + error))
