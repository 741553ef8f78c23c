"""One-row facts (latest date, totals, offsets) used as literals, and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fact(df: DataFrame, **aggregates: Column) -> Column:
    """A struct of ungrouped aggregates as a scalar subquery: no join, no collect."""
    row = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return row.select(F.struct(*aggregates)).scalar()


def latest(df: DataFrame, date: str = "date") -> Column:
    return df.agg(F.max(date)).scalar()


# Bin widths of the two passes below, as bins per unit of log1p(|x|).
_COARSE, _FINE = 2.0**8, 2.0**24


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation between order statistics, one row per group.

    The built-in exact ``percentile`` gathers every distinct value of a group in one task. Here a
    histogram over fixed bins, counted before the shuffle, locates the bin of each wanted rank. Only the
    values of those bins are shuffled: equal ones are merged, narrowed down by a finer histogram, and the
    few left are ordered. Bins are a monotone function of ``log1p(|x|)``, so the ranks are found exactly
    whatever the distribution, and no task sees a whole group. NaN counts as missing, like null.
    """
    by = list(by)
    # A group is one struct and never null itself, so null keys form a group like any other.
    group = F.struct(*by) if by else F.lit(0)
    values = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group.alias("_g"), F.col(value).alias("_v"))

    def bins(scale: float) -> Column:
        return F.coalesce((F.signum("_v") * F.floor(F.log1p(F.abs("_v")) * scale)).cast("long"), F.lit(0))

    def target(name: str, p: float, up: int) -> Column:
        at = (F.col("_total") - 1) * F.lit(p)
        return F.struct(F.lit(name).alias("name"), (F.floor(at) + up).alias("rank"), at.alias("at"))

    # First pass: which coarse bins hold the wanted ranks?
    binned = values.withColumn("_bin", bins(_COARSE))
    coarse = binned.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    targets = F.array(*[target(name, p, up) for name, p in probs.items() for up in (0, 1)])
    located = (
        coarse.withColumn("_total", F.sum("_n").over(Window.partitionBy("_g")))
        .withColumn("_targets", targets)
        .withColumn("_offset", F.lit(0))
    )
    located = _locate(located, ["_g"], "_bin")

    # Second pass: the values of those bins, merged, and split into fine bins.
    cell = ["_g", "_bin"]
    near = (
        binned.join(located, cell)
        .groupBy(*cell, "_v", "_targets", "_offset")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_sub", bins(_FINE))
    )
    fine = near.groupBy(*cell, "_sub", "_targets", "_offset").agg(F.sum("_n").alias("_n"))

    # Last: order the values of the fine bins that matter.
    cell = [*cell, "_sub"]
    last = near.drop("_targets", "_offset").join(_locate(fine, cell[:2], "_sub"), cell)
    hits = _locate(last, cell, "_v").select("_g", "_v", F.inline("_targets"))

    # Two neighbouring order statistics per quantile; the last rank has no upper neighbour.
    per_prob = hits.groupBy("_g", "name", "at").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    result = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    found = per_prob.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, result)).alias(name) for name in probs])
    return found.select("_g.*", *probs) if by else found.select(*probs)


def _locate(parts: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Parts of a cell, in order, that hold wanted ranks: with those ranks, and the values before the part.

    ``_offset`` is the number of values of the group before the cell, ``_n`` that of the part.
    """
    before = F.sum("_n").over(Window.partitionBy(*cell).orderBy(order)) - F.col("_n") + F.col("_offset")
    inside = F.filter("_targets", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_n")))
    return (
        parts.withColumn("_before", before)
        .withColumn("_targets", inside)
        .where(F.size("_targets") > 0)
        .select(*cell, order, "_targets", F.col("_before").alias("_offset"))
    )
