"""Additive explanations: long contribution tables, waterfalls and their chart segments.

A row carries its contributions as an array, so ranking, grouping of the rest and running sums happen
inside the row: no shuffle, whatever the number of predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER_THRESHOLD = 0.01


def contributions_from_arrays(df: DataFrame, names: str = "names", values: str = "values", contributions: str = "shap_values") -> Column:
    """Build the ``contributions`` array out of parallel arrays."""
    return F.transform(
        F.arrays_zip(F.col(names), F.col(values), F.col(contributions)),
        lambda z, i: F.struct(
            i.alias("position"), z[names].alias("feature"), z[values].alias("value"), z[contributions].alias("contribution")
        ),
    )


def explode_contributions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: keys, base_value, position, feature, value, contribution."""
    return df.select(*keys, "base_value", F.inline("contributions"))


def contribution_gate(df: DataFrame, limit: float = 1000.0, tol: float = 1e-6) -> DataFrame:
    """Counts of rows that are not finite, too large, or do not add up to their prediction."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    bad = F.exists("contributions", lambda c: F.isnan(c["contribution"]) | (F.abs(c["contribution"]) == float("inf")) | c["contribution"].isNull())
    large = F.exists("contributions", lambda c: F.abs(c["contribution"]) >= limit)
    gap = F.abs(F.col("base_value") + total - F.col("prediction")) > tol * F.greatest(F.lit(1.0), F.abs("prediction"))
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_not_finite"),
        F.count_if(large).alias("n_too_large"),
        F.count_if(gap).alias("n_not_additive"),
    )
    return counts.withColumn(
        "passed", (F.col("n_not_finite") == 0) & (F.col("n_too_large") == 0) & (F.col("n_not_additive") == 0)
    )


def _direction(x: Column) -> Column:
    return F.when(x > 0, "positive").otherwise("negative")


def waterfall(df: DataFrame, k: int = 10) -> DataFrame:
    """Add ``steps`` and the ``prediction`` they end at.

    Steps are the k largest contributions by absolute value (ties in feature order), then one for all
    others together if that exceeds the threshold: name, value, contribution, cumulative, direction.
    """
    ranked = F.sort_array(
        F.transform(
            "contributions",
            lambda c: F.struct(
                (-F.abs(c["contribution"])).alias("rank"), c["position"].alias("position"),
                c["feature"].alias("name"), c["value"].alias("value"), c["contribution"].alias("contribution"),
            ),
        )
    )

    def step(name: Column, value: Column, contribution: Column) -> Column:
        return F.struct(name.alias("name"), value.cast("double").alias("value"), contribution.alias("contribution"))

    top = F.transform(F.slice("_ranked", 1, k), lambda c: step(c["name"], c["value"], c["contribution"]))
    rest = F.filter("_ranked", lambda c, i: i >= k)
    other = F.array(step(F.format_string("Other (%d features)", F.size("_rest")), F.lit(None), F.col("_other")))
    with_rest = (
        df.withColumn("_ranked", ranked)
        .withColumn("_rest", rest)
        .withColumn("_other", F.aggregate("_rest", F.lit(0.0), lambda a, c: a + c["contribution"]))
        .withColumn("_steps", F.when(F.abs("_other") > OTHER_THRESHOLD, F.concat(top, other)).otherwise(top))
    )

    def running(c: Column, i: Column) -> Column:
        upto = F.aggregate(F.slice("_steps", F.lit(1), i + 1), F.col("base_value"), lambda a, s: a + s["contribution"])
        return F.struct(
            c["name"].alias("name"), c["value"].alias("value"), c["contribution"].alias("contribution"),
            upto.alias("cumulative"), _direction(c["contribution"]).alias("direction"),
        )

    return (
        with_rest.withColumn("steps", F.transform("_steps", running))
        .withColumn("prediction", F.coalesce(F.try_element_at("steps", F.lit(-1))["cumulative"], F.col("base_value")))
        .drop("_ranked", "_rest", "_other", "_steps")
    )


def waterfall_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of :func:`waterfall`, one row per step, numbered from 1.

    The outer form keeps Spark from deriving a size filter, which would compute all steps a second time.
    """
    rows = df.select(*keys, "base_value", "prediction", F.posexplode_outer("steps").alias("_i", "_s"))
    return rows.where(F.col("_i").isNotNull()).select(
        *keys, "base_value", "prediction", (F.col("_i") + 1).alias("step"), "_s.*"
    )


def waterfall_segments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chart bars: base from 0, each step between its two running sums, the prediction from 0."""

    def bar(name: Column, start: Column, end: Column, value: Column, direction: Column) -> Column:
        return F.struct(name.alias("name"), start.alias("start"), end.alias("end"), value.alias("value"), direction.alias("direction"))

    def segment(s: Column) -> Column:
        before = s["cumulative"] - s["contribution"]
        return bar(s["name"], F.least(before, s["cumulative"]), F.greatest(before, s["cumulative"]), s["contribution"], s["direction"])

    base, total, zero = F.col("base_value"), F.col("prediction"), F.lit(0.0)
    bars = F.concat(
        F.array(bar(F.lit("Base Value"), zero, base, base, F.lit("base"))),
        F.transform("steps", segment),
        F.array(bar(F.lit("Prediction"), zero, total, total, F.lit("prediction"))),
    )
    return df.select(*keys, F.posexplode(bars).alias("bar", "_b")).select(*keys, "bar", "_b.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. An aggregate with map-side combine, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def export_waterfalls(
    df: DataFrame, pairs: DataFrame | None = None, n: int = 100, k: int = 10,
    keys: Sequence[str] = ("store_nbr", "family"), order: Sequence[str] = ("date",),
) -> DataFrame:
    """Waterfalls of the first match of each wanted (store, family), or else of the first n rows."""
    if pairs is None:
        return waterfall(df.orderBy(*order, *keys).limit(n), k)
    return waterfall(first_per_key(df.join(pairs.select(*keys), list(keys), "left_semi"), keys, order), k)
