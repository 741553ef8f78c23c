"""Batch requests: validation, lookups, history, comparison and batch prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import linear
from ..operators import requests as ops
from ..operators.intervals import fallback_band, interval_offsets
from ..plans.batch import batch_predict
from . import base
from .base import LINEAR_FEATURES, define, predict_sql, r, rounded, sql_table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def requests(spark, sf_dir) -> DataFrame:
    """A request per sales row, with planted errors: row_id, store_nbr, family, date (text), horizon.

    Half of the requests ask for a day far ahead, and some for a store without sales.
    """
    d = F.col("_day")
    dom = F.dayofmonth(d)
    position = F.array_position(F.lit(list(SEGMENTS)), F.col("family"))
    row_id = F.unix_date(d) * 1000 + F.col("store_nbr") * 100 + position
    asked = F.when(F.pmod(F.col("row_id"), F.lit(2)) == 0, d).otherwise(F.date_add(d, 3650))
    return (
        base.fact(spark, sf_dir).withColumnRenamed("date", "_day").withColumn("row_id", row_id.cast("long"))
        .select(
            "row_id",
            F.when(F.dayofyear(d) % 50 == 0, 0).when(dom == 23, 99).otherwise(F.col("store_nbr")).alias("store_nbr"),
            F.when(dom == 13, "UNKNOWN").when(dom == 14, "").otherwise(F.col("family")).alias("family"),
            F.when(dom == 17, F.date_format(d, "MM/dd/yyyy"))
            .when(dom == 18, "")
            .when(dom == 19, F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")))
            .otherwise(asked.cast("string"))
            .alias("date"),
            F.when(dom == 21, 45)
            .otherwise(F.element_at(F.array(F.lit(15), F.lit(30), F.lit(60), F.lit(90)), F.weekday(d) % 4 + 1))
            .alias("horizon"),
        )
    )


define("request_rows", f"""
SELECT row_id,
       CASE WHEN dayofyear(d) % 50 = 0 THEN 0 WHEN day(d) = 23 THEN 99 ELSE store_nbr END AS store_nbr,
       CASE WHEN day(d) = 13 THEN 'UNKNOWN' WHEN day(d) = 14 THEN '' ELSE family END AS family,
       CASE WHEN day(d) = 17 THEN strftime(d, '%m/%d/%Y') WHEN day(d) = 18 THEN ''
            WHEN day(d) = 19 THEN strftime(d, '%Y') || '-02-30'
            WHEN row_id % 2 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d + 3650, '%Y-%m-%d') END AS date,
       CASE WHEN day(d) = 21 THEN 45 ELSE [15, 30, 60, 90][(isodow(d) - 1) % 4 + 1] END AS horizon
FROM (SELECT date AS d, store_nbr, family,
             CAST((date - DATE '1970-01-01') * 1000 + store_nbr * 100
                  + list_position([{", ".join(f"'{s}'" for s in SEGMENTS)}], family) AS BIGINT) AS row_id
      FROM fact_region)""")
define("request_checked", """
SELECT *, CASE WHEN store_nbr IS NULL OR store_nbr <= 0 THEN 'INVALID_STORE'
     WHEN coalesce(family, '') = '' THEN 'MISSING_FAMILY'
     WHEN family NOT IN (SELECT DISTINCT family FROM fact_region) THEN 'INVALID_FAMILY'
     WHEN coalesce(date, '') = '' THEN 'MISSING_DATE'
     WHEN NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') OR try_cast(date AS DATE) IS NULL THEN 'INVALID_DATE'
     WHEN horizon NOT IN (15, 30, 60, 90) THEN 'INVALID_HORIZON' END AS code
FROM request_rows""")
define("request_judged", """
SELECT *, CASE code WHEN 'INVALID_STORE' THEN 'store_nbr must be positive' WHEN 'MISSING_FAMILY' THEN 'family is required'
     WHEN 'INVALID_FAMILY' THEN 'invalid family name: ' || family WHEN 'MISSING_DATE' THEN 'date is required'
     WHEN 'INVALID_DATE' THEN 'date must be in YYYY-MM-DD format'
     WHEN 'INVALID_HORIZON' THEN 'horizon must be 15, 30, 60, or 90' END AS message
FROM request_checked""")
define("request_valid", "SELECT row_id, store_nbr, family, CAST(date AS DATE) AS date, horizon FROM request_judged WHERE code IS NULL")


def families(spark, sf_dir) -> Column:
    """The product families as an array; their number is bounded by the dimension."""
    return base.fact(spark, sf_dir).agg(F.collect_set("family")).scalar()


def validated(spark, sf_dir) -> DataFrame:
    return ops.validate_requests(requests(spark, sf_dir), families(spark, sf_dir))


def valid_requests(spark, sf_dir) -> DataFrame:
    good, _ = ops.split_requests(validated(spark, sf_dir))
    return good.withColumn("date", F.to_date("date"))


def c9_validated_requests(spark, sf_dir):
    return validated(spark, sf_dir)


def c9_feature_length(spark, sf_dir):
    n = F.element_at(F.array(F.lit(27), F.lit(0), F.lit(26)), F.dayofmonth("_d") % 3 + 1)
    rows = requests(spark, sf_dir).withColumn("_d", F.date_from_unix_date((F.col("row_id") / 1000).cast("int")))
    with_vector = rows.withColumn("features", F.array_repeat(F.lit(1.0), n)).drop("_d")
    judged = ops.validate_requests(with_vector, families(spark, sf_dir), max_store=54)
    return judged.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))


def c10_split_counts(spark, sf_dir):
    good, bad = ops.split_requests(validated(spark, sf_dir))
    n = F.count(F.lit(1)).alias("n_rows")
    return good.agg(n).select(F.lit("valid").alias("side"), "n_rows").unionByName(
        bad.agg(n).select(F.lit("invalid").alias("side"), "n_rows")
    )


def c10_error_summary(spark, sf_dir):
    _, bad = ops.split_requests(validated(spark, sf_dir))
    return ops.error_summary(bad)


def c11_capped_batch(spark, sf_dir):
    return ops.cap_batch(valid_requests(spark, sf_dir))


def c11_batch_size(spark, sf_dir):
    return ops.batch_size_code(valid_requests(spark, sf_dir))


def j6_feature_lookup(spark, sf_dir):
    columns = ["year", "oil_price", "sales_lag_7", "sales_rolling_mean_28"]
    found = ops.lookup_features(valid_requests(spark, sf_dir), base.staged_features(spark, sf_dir), columns)
    return rounded(found, 4, *columns)


def j7_history(spark, sf_dir):
    asked = requests(spark, sf_dir).where(F.col("date").rlike(r"^\d{4}-\d\d-\d\d$")).select(
        "row_id", "store_nbr", "family", F.try_to_date("date").alias("end_date"), (F.col("horizon") - 15).alias("days")
    ).where(F.col("end_date").isNotNull())
    return rounded(ops.history(asked, base.fact(spark, sf_dir), base.staged_features(spark, sf_dir)), 2, "actual")


def _forecasts(spark, sf_dir) -> DataFrame:
    p = F.col("sales_lag_7")
    return base.staged_features(spark, sf_dir).select(
        "unique_id", F.col("date").alias("ds"), p.alias("prediction"), (p - 100).alias("lower_80"), (p + 100).alias("upper_80")
    )


def _pairs(spark, sf_dir) -> DataFrame:
    """Each valid request compared with the same family of the next store."""
    here, there = F.col("store_nbr"), F.col("store_nbr") % 5 + 1
    return valid_requests(spark, sf_dir).select(
        "row_id", F.concat_ws("_", here.cast("string"), "family").alias("id_a"),
        F.concat_ws("_", there.cast("string"), "family").alias("id_b"), "date", "horizon",
    )


def j8_compare_series(spark, sf_dir):
    return ops.compare_series(_pairs(spark, sf_dir), _forecasts(spark, sf_dir))


def a14_comparison_stats(spark, sf_dir):
    from ..operators.evaluate import comparison_stats

    points = ops.compare_series(_pairs(spark, sf_dir), _forecasts(spark, sf_dir))
    stats = comparison_stats(points, by=["id_a", "id_b"])
    return rounded(stats, 2, "total_a", "total_b", "avg_a", "avg_b", "avg_delta", "avg_delta_pct")


def scored_requests(spark, sf_dir) -> DataFrame:
    """Batch prediction with the SQL-checked linear model and the bands of its residuals."""
    feats = base.staged_features(spark, sf_dir)
    model = linear.marginal_linear(feats, LINEAR_FEATURES)
    fitted = linear.score_linear(feats, model)
    return batch_predict(
        requests(spark, sf_dir), feats, LINEAR_FEATURES,
        lambda df: linear.score_linear(df, model),
        interval_offsets(fitted, "sales", "prediction"), families(spark, sf_dir),
    )


def f11_batch_prediction(spark, sf_dir):
    return rounded(scored_requests(spark, sf_dir), 2, "prediction", "lower_80", "upper_80", "lower_95", "upper_95")


def a15_batch_status(spark, sf_dir):
    status = F.when(F.col("code").isNotNull(), "error").when(F.col("horizon") == 90, "pending").otherwise("success")
    return ops.batch_status(validated(spark, sf_dir).withColumn("status", status))


def a8_fallback_band(spark, sf_dir):
    p = F.col("sales_lag_7")
    have = F.dayofmonth("date") % 2 == 0
    rows = base.staged_features(spark, sf_dir).select(
        "unique_id", "date", p.alias("prediction"),
        F.when(have, F.greatest(F.lit(0.0), p - 100000)).alias("lower_80"), F.when(have, p + 100000).alias("upper_80"),
        F.when(have, F.greatest(F.lit(0.0), p - 200000)).alias("lower_95"), F.when(have, p + 200000).alias("upper_95"),
    )
    return rounded(fallback_band(rows), 4, "lower_80", "upper_80", "lower_95", "upper_95")


QUERIES = {
    f.__name__: f
    for f in (
        c9_validated_requests, c9_feature_length, c10_split_counts, c10_error_summary, c11_capped_batch, c11_batch_size,
        j6_feature_lookup, j7_history, j8_compare_series, a14_comparison_stats, f11_batch_prediction, a15_batch_status,
        a8_fallback_band,
    )
}

_ALL = ("year", "oil_price", "sales_lag_7", "sales_rolling_mean_28")
define("series_means", "SELECT store_nbr, family, " + ", ".join(
    f"avg(coalesce({c}, 0)) AS {c}" for c in dict.fromkeys((*_ALL, *LINEAR_FEATURES))) + " FROM features_28 GROUP BY ALL")


def _looked_up(source: str, columns, places: int | None = 4) -> str:
    picks = ", ".join(
        (f"round(coalesce(e.{c}, m.{c}, 0), {places})" if places is not None else f"coalesce(e.{c}, m.{c}, 0)") + f" AS {c}" for c in columns
    )
    return f"""
SELECT q.*, {picks}, CASE WHEN e.date IS NOT NULL THEN 'exact' WHEN m.family IS NOT NULL THEN 'aggregated' ELSE 'zero_fallback' END AS source
FROM {source} q LEFT JOIN features_28 e ON q.store_nbr = e.store_nbr AND q.family = e.family AND q.date = e.date
LEFT JOIN series_means m ON q.store_nbr = m.store_nbr AND q.family = m.family"""


define("compared", """
SELECT q.row_id, q.store_nbr || '_' || q.family AS id_a, (q.store_nbr % 5 + 1) || '_' || q.family AS id_b, q.ds,
       a.sales_lag_7 AS store_a, a.sales_lag_7 - 100 AS lower_80_a, a.sales_lag_7 + 100 AS upper_80_a,
       b.sales_lag_7 AS store_b, b.sales_lag_7 - 100 AS lower_80_b, b.sales_lag_7 + 100 AS upper_80_b
FROM (SELECT *, CAST(unnest(generate_series(date, date + CAST(ceil(horizon / 7) - 1 AS INTEGER) * 7, INTERVAL 7 DAY)) AS DATE) AS ds FROM request_valid) q
LEFT JOIN features_28 a ON a.unique_id = q.store_nbr || '_' || q.family AND a.date = q.ds
LEFT JOIN features_28 b ON b.unique_id = (q.store_nbr % 5 + 1) || '_' || q.family AND b.date = q.ds""")
define("model_residuals", f"SELECT sales - {predict_sql()} AS e FROM features_28 f, model_params p")
define("model_offsets", """
SELECT quantile_cont(e, 0.1) AS l80, quantile_cont(e, 0.9) AS u80, quantile_cont(e, 0.025) AS l95, quantile_cont(e, 0.975) AS u95 FROM model_residuals""")
define("request_features", _looked_up("request_valid", LINEAR_FEATURES, None))
define("request_scored", f"SELECT f.row_id, f.source, {predict_sql()} AS prediction FROM request_features f, model_params p")

_FILL = "lower_80 IS NOT NULL AND lower_80 <> 0"
SQL = sql_table(
    c9_validated_requests="SELECT * FROM request_judged",
    c9_feature_length="""
SELECT code, count(*) AS n_rows FROM (
  SELECT CASE WHEN code = 'INVALID_STORE' OR store_nbr > 54 THEN 'INVALID_STORE' WHEN code IS NOT NULL THEN code
     WHEN day(DATE '1970-01-01' + CAST(row_id // 1000 AS INTEGER)) % 3 = 1 THEN 'MISSING_FEATURES'
     WHEN day(DATE '1970-01-01' + CAST(row_id // 1000 AS INTEGER)) % 3 = 2 THEN 'INVALID_FEATURES' END AS code FROM request_judged)
GROUP BY code""",
    c10_split_counts="SELECT CASE WHEN code IS NULL THEN 'valid' ELSE 'invalid' END AS side, count(*) AS n_rows FROM request_judged GROUP BY 1",
    c10_error_summary="""
SELECT position, text FROM (SELECT row_id AS position, 'Row ' || row_id || ': ' || message AS text
  FROM request_judged WHERE code IS NOT NULL ORDER BY row_id LIMIT 10)
UNION ALL SELECT max(row_id) + 1, '... and ' || (count(*) - 10) || ' more errors' FROM request_judged WHERE code IS NOT NULL HAVING count(*) > 10""",
    c11_capped_batch="SELECT * FROM request_valid ORDER BY row_id LIMIT 100",
    c11_batch_size="SELECT count(*) AS n_rows, CASE WHEN count(*) = 0 THEN 'EMPTY_BATCH' WHEN count(*) > 100 THEN 'BATCH_TOO_LARGE' END AS code FROM request_valid",
    j6_feature_lookup=_looked_up("request_valid", _ALL),
    j7_history="""
SELECT g.row_id, g.store_nbr, g.family, g.date,
       round(coalesce(f.sales, CASE WHEN coalesce(e.sales_lag_7, m.sales_lag_7) > 0 THEN coalesce(e.sales_lag_7, m.sales_lag_7) END), 2) AS actual,
       CASE WHEN f.sales IS NOT NULL THEN 'actual' ELSE 'lag' END AS origin
FROM (SELECT row_id, store_nbr, family,
             CAST(unnest(generate_series(end_date - days, end_date - 1, INTERVAL 7 DAY)) AS DATE) AS date
      FROM (SELECT *, try_cast(date AS DATE) AS end_date, CASE WHEN horizon > 15 THEN least(horizon - 15, 365) ELSE 28 END AS days
            FROM request_rows WHERE regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}')) WHERE end_date IS NOT NULL) g
LEFT JOIN fact_region f ON g.store_nbr = f.store_nbr AND g.family = f.family AND g.date = f.date
LEFT JOIN features_28 e ON g.store_nbr = e.store_nbr AND g.family = e.family AND g.date = e.date
LEFT JOIN series_means m ON g.store_nbr = m.store_nbr AND g.family = m.family
WHERE f.sales IS NOT NULL OR coalesce(e.sales_lag_7, m.sales_lag_7) > 0""",
    j8_compare_series="SELECT * FROM compared",
    a14_comparison_stats="""
SELECT id_a, id_b, n_points, round(total_a, 2) AS total_a, round(total_b, 2) AS total_b, round(avg_a, 2) AS avg_a, round(avg_b, 2) AS avg_b,
       round(avg_a - avg_b, 2) AS avg_delta, round(CASE WHEN avg_b = 0 THEN 0 ELSE (avg_a - avg_b) / avg_b * 100 END, 2) AS avg_delta_pct,
       CASE WHEN avg_a > avg_b THEN 'higher' WHEN avg_a < avg_b THEN 'lower' ELSE 'equal' END AS comparison
FROM (SELECT id_a, id_b, count(both_) AS n_points, coalesce(sum(store_a) FILTER (WHERE both_), 0) AS total_a,
             coalesce(sum(store_b) FILTER (WHERE both_), 0) AS total_b, coalesce(avg(store_a) FILTER (WHERE both_), 0) AS avg_a,
             coalesce(avg(store_b) FILTER (WHERE both_), 0) AS avg_b
      FROM (SELECT *, CASE WHEN store_a IS NOT NULL AND store_b IS NOT NULL THEN true END AS both_ FROM compared) GROUP BY id_a, id_b)""",
    f11_batch_prediction="""
SELECT q.row_id, q.store_nbr, q.family, q.date, q.horizon, round(s.prediction, 2) AS prediction,
       round(CASE WHEN q.code IS NULL THEN greatest(s.prediction + o.l80, 0) END, 2) AS lower_80, round(s.prediction + o.u80, 2) AS upper_80,
       round(CASE WHEN q.code IS NULL THEN greatest(s.prediction + o.l95, 0) END, 2) AS lower_95, round(s.prediction + o.u95, 2) AS upper_95,
       s.source, CASE WHEN q.code IS NULL THEN 'success' ELSE 'error' END AS status, q.message AS error
FROM request_judged q LEFT JOIN request_scored s ON q.row_id = s.row_id LEFT JOIN model_offsets o ON q.code IS NULL""",
    a15_batch_status="""
SELECT count(*) FILTER (WHERE code IS NULL AND horizon <> 90) AS n_success, count(*) FILTER (WHERE code IS NOT NULL) AS n_error,
       count(*) FILTER (WHERE code IS NULL AND horizon = 90) AS n_pending FROM request_judged""",
    a8_fallback_band=f"""
SELECT unique_id, date, prediction, round(CASE WHEN {_FILL} THEN lower_80 ELSE greatest(0, prediction - prediction * 0.10) END, 4) AS lower_80,
       round(CASE WHEN {_FILL} THEN upper_80 ELSE prediction + prediction * 0.10 END, 4) AS upper_80,
       round(CASE WHEN {_FILL} THEN lower_95 ELSE greatest(0, prediction - prediction * 0.15) END, 4) AS lower_95,
       round(CASE WHEN {_FILL} THEN upper_95 ELSE prediction + prediction * 0.15 END, 4) AS upper_95
FROM (SELECT unique_id, date, sales_lag_7 AS prediction,
        CASE WHEN day(date) % 2 = 0 THEN greatest(0, sales_lag_7 - 100000) END AS lower_80, CASE WHEN day(date) % 2 = 0 THEN sales_lag_7 + 100000 END AS upper_80,
        CASE WHEN day(date) % 2 = 0 THEN greatest(0, sales_lag_7 - 200000) END AS lower_95, CASE WHEN day(date) % 2 = 0 THEN sales_lag_7 + 200000 END AS upper_95
      FROM features_28)""",
)
