"""Counts taken in the job that writes a stage, and sketches kept per window and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import stages
from ..session import scratch_dir
from ..sources import sample
from ..streaming import sketches
from . import base
from .base import define, r, sql_table

QUANTILES = (0.5, 0.95, 0.99)


def _raw(spark, sf_dir):
    """The fact as it might come in: some sales are negative, and those of the ninth day of a month are missing."""
    sales = F.when(F.dayofmonth("date") != 9, r(F.col("sales") - 60000, 2))
    return base.fact(spark, sf_dir).withColumn("sales", sales)


def _row(spark, counts: dict, *names: str):
    kinds = {"first": "date", "last": "date"}
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def c1_observed_stage(spark, sf_dir):
    """Counts of the cleaning job, rows with nulls left out, beside what the stage really holds."""
    path = scratch_dir(spark, "clean_sales")
    counts = stages.write_clean_sales(_raw(spark, sf_dir), path, nulls="drop")
    told = _row(spark, counts, "n_rows", "n_negative", "null_sales", "null_family", "n_written", "first", "last")
    held = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_held"), F.count_if(F.col("sales") < 0).alias("n_below"), F.count_if(F.col("sales").isNull()).alias("n_without"))
    return told.withColumns({c: F.lit(v) for c, v in held.first().asDict().items()})


def c6_observed_features(spark, sf_dir):
    """Two stages, each one job: clean sales, then the feature matrix by row; the counts of the second."""
    clean, matrix = scratch_dir(spark, "clean_sales"), scratch_dir(spark, "features")
    stages.write_clean_sales(base.fact(spark, sf_dir), clean)
    counts = stages.write_features(spark.read.parquet(clean), sample.external(spark, sf_dir), matrix, 90)
    return _row(spark, counts, "n_rows", "n_dropped", "n_written").withColumn("n_held", F.lit(spark.read.parquet(matrix).count()))


def w6_staged_matrix(spark, sf_dir):
    """The written feature stage itself, from a fact that the first stage has cleaned."""
    clean, matrix = scratch_dir(spark, "clean_sales"), scratch_dir(spark, "features")
    stages.write_clean_sales(base.fact(spark, sf_dir), clean)
    stages.write_features(spark.read.parquet(clean), sample.external(spark, sf_dir), matrix, 90)
    kept = spark.read.parquet(matrix)
    return kept.select("unique_id", "date", "sales", "onpromotion", "oil_price", "sales_lag_90", "promo_rolling_7", "dayofweek")


def _sketched(spark, sf_dir):
    return sketches.window_sketches(base.events(spark, sf_dir), "seconds", "user_id", ["endpoint"])


def e4_merged_sketches(spark, sf_dir):
    """Quantiles of each endpoint and day from hourly sketches: their ranks among the events lie within the bound."""
    day = F.to_date("window_start").alias("day")
    estimates = sketches.quantiles_of(sketches.merged(_sketched(spark, sf_dir), ["endpoint", day]), QUANTILES, ["endpoint", "day"])
    events = base.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    found = sketches.rank_within(estimates, events, "seconds", ["endpoint", "day"], sketches.rank_error())
    return found.select("endpoint", "day", "q", "n", "within")


def a16_merged_distinct_counts(spark, sf_dir):
    """Distinct users of each endpoint from hourly sketches, against the exact number."""
    estimates = sketches.distinct_of(sketches.merged(_sketched(spark, sf_dir), ["endpoint"]), ["endpoint"])
    exact = base.events(spark, sf_dir).groupBy("endpoint").agg(F.count_distinct("user_id").alias("n_users"))
    near = F.abs(F.col("n_distinct") - F.col("n_users")) <= F.col("n_users") * F.lit(sketches.distinct_error()) + 1
    return exact.join(estimates, "endpoint").select("endpoint", "n_users", near.alias("within"))


QUERIES = {f.__name__: f for f in (c1_observed_stage, c6_observed_features, w6_staged_matrix, e4_merged_sketches, a16_merged_distinct_counts)}

define("raw_fact", "SELECT date, family, CASE WHEN day(date) <> 9 THEN round(sales - 60000, 2) END AS sales FROM fact_region")

SQL = sql_table(
    c1_observed_stage="""
SELECT count(*) AS n_rows, count(*) FILTER (sales < 0) AS n_negative, count(*) FILTER (sales IS NULL) AS null_sales, count(*) FILTER (family IS NULL) AS null_family,
  count(sales) AS n_written, min(date) AS first, max(date) AS last, count(sales) AS n_held, CAST(0 AS BIGINT) AS n_below, CAST(0 AS BIGINT) AS n_without FROM raw_fact""",
    c6_observed_features="""
SELECT (SELECT count(*) FROM fact_region) AS n_rows, (SELECT count(*) FROM fact_region) - count(*) AS n_dropped, count(*) AS n_written, count(*) AS n_held FROM features_90""",
    w6_staged_matrix="SELECT unique_id, date, sales, onpromotion, oil_price, sales_lag_90, promo_rolling_7, dayofweek FROM features_90",
    e4_merged_sketches="""
SELECT endpoint, CAST(ts AS DATE) AS day, CAST(q AS DOUBLE) AS q, count(seconds) AS n, true AS within FROM events_shaped, (VALUES (0.5), (0.95), (0.99)) t(q)
WHERE seconds IS NOT NULL GROUP BY endpoint, CAST(ts AS DATE), q""",
    a16_merged_distinct_counts="SELECT endpoint, count(DISTINCT user_id) AS n_users, true AS within FROM events_shaped GROUP BY endpoint",
)
