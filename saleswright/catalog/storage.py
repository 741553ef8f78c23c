"""Sources, sinks and snapshots. Round trips write to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import floor_zero
from ..operators.evaluate import metrics
from ..session import scratch_dir
from ..sources import files, sample, stages
from . import base
from .base import define, r, rounded, sql_table
from .lookups import requests


def s1_csv_fact(spark, sf_dir):
    path = files.write_csv(base.fact(spark, sf_dir), scratch_dir(spark, "sales.csv"))
    return files.read_sales(spark, path)


def s2_external_tables(spark, sf_dir):
    """All four side tables, written and read again: name, key, label and value of every row."""
    folder = scratch_dir(spark, "external")
    visits = base.fact(spark, sf_dir).groupBy("date", "store_nbr").agg(F.sum("onpromotion").alias("transactions"))
    for name, df in {**sample.external(spark, sf_dir), "transactions": visits}.items():
        files.write_csv(df, f"{folder}/{files.EXTERNAL_FILES.get(name, name)}.csv")
    found = files.read_external(spark, folder)
    day, none = F.col("date").cast("string"), F.lit(None)
    shown = {
        "oil": (day, none, "dcoilwtico"), "holidays": (day, F.concat_ws("/", "type", "locale"), none),
        "stores": (F.col("store_nbr").cast("string"), F.concat_ws("/", "city", "type"), "cluster"),
        "transactions": (F.concat_ws("/", day, "store_nbr"), none, "transactions"),
    }
    column = lambda x: F.col(x) if isinstance(x, str) else x
    parts = [
        found[name].select(F.lit(name).alias("name"), key.alias("key"), label.cast("string").alias("label"), column(value).cast("double").alias("value"))
        for name, (key, label, value) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def s3_feature_scan(spark, sf_dir):
    path = stages.write_stage(base.features(spark, sf_dir), scratch_dir(spark, "features"))
    scan = stages.read_features(spark, path).select("unique_id", "date", "sales", "sales_lag_7")
    return scan


def s4_stage_by_year(spark, sf_dir):
    df = base.fact(spark, sf_dir).withColumn("year", F.year("date"))
    path = stages.write_stage(df, scratch_dir(spark, "fact_by_year"), ["year"])
    by_year = spark.read.parquet(path).groupBy("year")
    return by_year.agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("sales"), 2).alias("sales"))


def s5_metrics_json(spark, sf_dir):
    scored = base.staged_features(spark, sf_dir)
    result = rounded(metrics(scored, ["family"], "sales", "sales_lag_7"), 3, "rmsle", "rmse", "mae", "mape")
    path = files.write_json(result, scratch_dir(spark, "metrics.json"))
    return files.read_metrics(spark, path, result.schema)


def s7_forecast_export(spark, sf_dir):
    f = F.col("sales_lag_7")
    points = base.staged_features(spark, sf_dir).select(
        "date", F.when(F.col("onpromotion") > 0, F.col("sales")).alias("actual"), f.alias("forecast"),
        floor_zero(f - 30000).alias("lower_80"), (f + 30000).alias("upper_80"),
        floor_zero(f - 60000).alias("lower_95"), (f + 60000).alias("upper_95"),
    )
    path = files.export_forecast(points, scratch_dir(spark, "forecast.csv"))
    text = spark.read.option("header", True).csv(path)
    return text.select("date", *[F.coalesce(c, F.lit("")).alias(c) for c in files.FORECAST_COLUMNS])


def s8_batch_requests(spark, sf_dir):
    raw = requests(spark, sf_dir).select(
        F.lower("family").alias(" Family "), F.col("date").alias("DATE"), F.col("store_nbr").alias("Store_Nbr"),
        "horizon", F.lit("x").alias("comment"),
    )
    path = files.write_csv(raw, scratch_dir(spark, "requests.csv"))
    return files.read_requests(spark, path).drop("row_id")


def s9_batch_results(spark, sf_dir):
    p = F.col("sales_lag_7")
    rows = base.staged_features(spark, sf_dir).select(
        "store_nbr", "family", "date", F.lit(30).alias("horizon"), p.alias("prediction"),
        floor_zero(p - 30000).alias("lower_80"), (p + 30000).alias("upper_80"),
        floor_zero(p - 60000).alias("lower_95"), (p + 60000).alias("upper_95"),
        F.when(F.dayofmonth("date") % 5 == 0, "error").otherwise("success").alias("status"),
    )
    path = files.write_batch_results(rows, scratch_dir(spark, "results.csv"))
    return spark.read.option("header", True).csv(path).select(
        F.col("store_nbr").cast("int"), "family", F.col("date").cast("date"), F.col("horizon").cast("int"), *files.BAND_COLUMNS
    )


def s10_snapshot_metadata(spark, sf_dir):
    return stages.snapshot_metadata(base.staged_features(spark, sf_dir), "v1")


def s11_snapshot_reload(spark, sf_dir):
    root = scratch_dir(spark, "snapshots")
    fact = base.fact(spark, sf_dir)
    stages.publish_snapshot(fact.where(F.year("date") < 2000), root, "v1")
    stages.publish_snapshot(fact, root, "v2")
    current = stages.refresh_snapshot(spark, root)
    return current.groupBy("version", "store_nbr").agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("max_date"))


NOW, LOADED = "2001-12-01 06:30:00", "2001-11-30 05:00:00"


def s12_snapshot_health(spark, sf_dir):
    meta = stages.snapshot_metadata(base.staged_features(spark, sf_dir), "v1")
    return stages.snapshot_health(meta, F.lit(NOW).cast("timestamp"), F.lit(LOADED).cast("timestamp"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_csv_fact, s2_external_tables, s3_feature_scan, s4_stage_by_year, s5_metrics_json, s7_forecast_export,
        s8_batch_requests, s9_batch_results, s10_snapshot_metadata, s11_snapshot_reload, s12_snapshot_health,
    )
}

define("snapshot", """
SELECT count(*) AS row_count, min(date) AS data_date_min, max(date) AS data_date_max, 'v1' AS version FROM features_28""")

_BOUNDS = {"lower_80": -30000, "upper_80": 30000, "lower_95": -60000, "upper_95": 60000}
_TEXT = ", ".join(
    f"printf('%.2f', {'greatest(sales_lag_7 + %d, 0)' % d if d < 0 else 'sales_lag_7 + %d' % d}) AS {name}" for name, d in _BOUNDS.items()
)

SQL = sql_table(
    s1_csv_fact="SELECT * FROM fact_region",
    s2_external_tables="""
SELECT 'oil' AS name, CAST(date AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS label, CAST(dcoilwtico AS DOUBLE) AS value FROM oil_quotes
UNION ALL SELECT 'holidays', CAST(date AS VARCHAR), type || '/' || locale, NULL FROM holiday_list
UNION ALL SELECT 'stores', CAST(store_nbr AS VARCHAR), city || '/' || type, CAST(cluster AS DOUBLE) FROM store_list
UNION ALL SELECT 'transactions', CAST(date AS VARCHAR) || '/' || store_nbr, NULL, CAST(sum(onpromotion) AS DOUBLE) FROM fact_region GROUP BY date, store_nbr""",
    s3_feature_scan="SELECT unique_id, date, sales, sales_lag_7 FROM features_28",
    s4_stage_by_year="""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, round(sum(sales), 2) AS sales
FROM fact_region GROUP BY 1""",
    s5_metrics_json="""
SELECT family, round(sqrt(avg(pow(ln(1 + sales) - ln(1 + sales_lag_7), 2))), 3) AS rmsle,
       round(sqrt(avg(pow(sales - sales_lag_7, 2))), 3) AS rmse, round(avg(abs(sales - sales_lag_7)), 3) AS mae,
       round(avg(abs(sales - sales_lag_7) / (abs(sales) + 1)), 3) AS mape, count(*) AS n_samples
FROM features_28 GROUP BY family""",
    s7_forecast_export=f"""
SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN onpromotion > 0 THEN printf('%.2f', sales) ELSE '' END AS actual,
       printf('%.2f', sales_lag_7) AS forecast, {_TEXT} FROM features_28""",
    s8_batch_requests="SELECT store_nbr, nullif(family, '') AS family, nullif(date, '') AS date, horizon FROM request_rows",
    s9_batch_results=f"""
SELECT store_nbr, family, date, 30 AS horizon, printf('%.2f', sales_lag_7) AS prediction, {_TEXT}
FROM features_28 WHERE day(date) % 5 <> 0""",
    s10_snapshot_metadata="SELECT * FROM snapshot",
    s11_snapshot_reload="SELECT 'v2' AS version, store_nbr, count(*) AS n_rows, max(date) AS max_date FROM fact_region GROUP BY store_nbr",
    s12_snapshot_health=f"""
SELECT *, row_count > 0 AS loaded, row_count > 0 AND TIMESTAMP '{NOW}' < TIMESTAMP '{LOADED}' + INTERVAL 24 HOUR AS fresh,
       CAST(datediff('minute', TIMESTAMP '{LOADED}', TIMESTAMP '{NOW}') // 60 AS BIGINT) AS age_hours,
       CAST(datediff('minute', CAST(data_date_max AS TIMESTAMP), TIMESTAMP '{NOW}') // 60 AS BIGINT) AS data_age_hours,
       CASE WHEN row_count = 0 THEN 'not loaded'
            WHEN TIMESTAMP '{NOW}' < TIMESTAMP '{LOADED}' + INTERVAL 24 HOUR THEN 'healthy' ELSE 'stale' END AS status
FROM snapshot""",
)
