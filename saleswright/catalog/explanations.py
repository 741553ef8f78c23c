"""Contributions, waterfalls and what-if on the SQL-checked linear model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, linear, model, whatif
from . import base
from .accuracy import contributions
from .base import LINEAR_FEATURES, define, predict_sql, rounded, sql_table

KEYS = ("unique_id", "date")
K = 5


def x1_contributions(spark, sf_dir):
    rows = contributions(spark, sf_dir).select(*KEYS, "base_value", "prediction", "contributions")
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
    return rounded(rows.select(*KEYS, "base_value", "prediction", total.alias("rebuilt")), 2, "base_value", "prediction", "rebuilt")


def x1_regression_contributions(spark, sf_dir):
    """The same for a regression fitted by Spark ML on the numeric features; the gate checks additivity."""
    feats = base.staged_features(spark, sf_dir).drop("type", "family")
    numeric, _ = model.available(feats)
    fitted = model.fit_linear(feats).stages[-1]
    rows = linear.linear_contributions(feats, linear.from_regression(fitted, feats, numeric))
    return explain.contribution_gate(rows, limit=1e9)


def x2_long_contributions(spark, sf_dir):
    rows = contributions(spark, sf_dir).select(
        *KEYS, "base_value",
        F.transform("contributions", lambda c: c["feature"]).alias("names"),
        F.transform("contributions", lambda c: c["value"]).alias("values"),
        F.transform("contributions", lambda c: c["contribution"]).alias("shap_values"),
    )
    packed = rows.withColumn("contributions", explain.contributions_from_arrays(rows))
    per_feature = explain.explode_contributions(packed, KEYS).groupBy("position", "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"), F.sum(F.abs("contribution")).alias("weight")
    )
    return rounded(per_feature, 2, "total", "weight")


def x3_contribution_gate(spark, sf_dir):
    return explain.contribution_gate(contributions(spark, sf_dir))


def _waterfalls(spark, sf_dir) -> DataFrame:
    return explain.waterfall(contributions(spark, sf_dir).select(*KEYS, "base_value", "contributions"), K)


def x4_waterfall(spark, sf_dir):
    rows = explain.waterfall_rows(_waterfalls(spark, sf_dir), KEYS)
    return rounded(rounded(rows, 2, "base_value", "prediction", "contribution", "cumulative"), 4, "value")


def x4_waterfall_documents(spark, sf_dir):
    return _waterfalls(spark, sf_dir).select(
        *KEYS, F.to_json(F.struct("base_value", F.col("steps").alias("features"), "prediction")).alias("document")
    )


def x5_waterfall_segments(spark, sf_dir):
    return rounded(explain.waterfall_segments(_waterfalls(spark, sf_dir), KEYS), 2, "start", "end", "value")


def x6_first_waterfalls(spark, sf_dir):
    rows = contributions(spark, sf_dir).select("store_nbr", "family", *KEYS, "base_value", "contributions")
    pairs = base.fact(spark, sf_dir).select("store_nbr", "family").distinct()
    first = explain.export_waterfalls(rows, pairs, k=K)
    long = explain.waterfall_rows(first, ["store_nbr", "family", "date"])
    return rounded(rounded(long, 2, "base_value", "prediction", "contribution", "cumulative"), 4, "value")


def x6_sample_waterfalls(spark, sf_dir):
    rows = contributions(spark, sf_dir).select("store_nbr", "family", *KEYS, "base_value", "contributions")
    first = explain.export_waterfalls(rows, n=100, k=K)
    return rounded(first.select("store_nbr", "family", "date", F.size("steps").alias("n_steps"), "prediction"), 2, "prediction")


def x7_what_if(spark, sf_dir):
    feats = base.staged_features(spark, sf_dir)
    lines = linear.marginal_linear(feats, LINEAR_FEATURES)
    d = F.dayofmonth("date")
    wanted = (
        F.when(d % 3 == 0, F.create_map(F.lit("oil_price"), F.lit(1.2), F.lit("is_payday"), F.lit(1.0)))
        .when(d % 3 == 1, F.create_map(F.lit("onpromotion"), F.lit(0.7), F.lit("month"), F.lit(15.0)))
        .otherwise(F.create_map(F.lit("day_of_week"), F.lit(0.0), F.lit("sales_lag_7"), F.lit(0.5)))
    )
    out = whatif.what_if(feats.select(*KEYS, *LINEAR_FEATURES, wanted.alias("adjustments")), lines)
    shown = out.select(
        *KEYS, "original", "adjusted", "delta", "delta_pct",
        F.array_join(F.array_sort(F.map_keys("applied")), ",").alias("applied"), F.array_join("skipped", ",").alias("skipped"),
    )
    return rounded(shown, 2, "original", "adjusted", "delta", "delta_pct")


def x8_sensitivity(spark, sf_dir):
    feats = base.staged_features(spark, sf_dir)
    lines = linear.marginal_linear(feats, LINEAR_FEATURES)
    grid = whatif.sensitivity(feats.select("unique_id", "date", *LINEAR_FEATURES), lines)
    means = grid.groupBy("unique_id", "adjust", "amount").agg(F.avg("original").alias("original"), F.avg("adjusted").alias("adjusted"))
    return rounded(means, 2, "original", "adjusted")


QUERIES = {
    f.__name__: f
    for f in (
        x1_contributions, x1_regression_contributions, x2_long_contributions, x3_contribution_gate, x4_waterfall,
        x4_waterfall_documents, x5_waterfall_segments, x6_first_waterfalls, x6_sample_waterfalls, x7_what_if, x8_sensitivity,
    )
}

define("ranked_contributions", """
SELECT *, row_number() OVER (PARTITION BY unique_id, date ORDER BY abs(contribution) DESC, position) AS rn FROM contribution_rows""")
define("waterfall_parts", f"""
SELECT unique_id, date, base_value, rn AS step, feature AS name, value, contribution FROM ranked_contributions WHERE rn <= {K}
UNION ALL SELECT unique_id, date, max(base_value), {K + 1}, 'Other (' || count(*) || ' features)', NULL, sum(contribution)
FROM ranked_contributions WHERE rn > {K} GROUP BY unique_id, date HAVING abs(sum(contribution)) > 0.01""")
define("waterfalls", """
SELECT *, base_value + sum(contribution) OVER (PARTITION BY unique_id, date ORDER BY step) AS cumulative,
       base_value + sum(contribution) OVER (PARTITION BY unique_id, date) AS prediction, max(step) OVER (PARTITION BY unique_id, date) AS last_step,
       CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS direction FROM waterfall_parts""")

_STEPS = """CAST(step AS INTEGER) AS step, round(base_value, 2) AS base_value, round(prediction, 2) AS prediction, name, round(value, 4) AS value,
       round(contribution, 2) AS contribution, round(cumulative, 2) AS cumulative, direction"""
_CHANGED = predict_sql(replaced={
    "oil_price": "CASE WHEN k = 0 THEN f.oil_price * 1.2 ELSE f.oil_price END",
    "onpromotion": "CASE WHEN k = 1 THEN 1 ELSE f.onpromotion END",
    "month": "CASE WHEN k = 1 THEN 12 ELSE f.month END",
    "dayofweek": "CASE WHEN k = 2 THEN 1 ELSE f.dayofweek END",
    "sales_lag_7": "CASE WHEN k = 2 THEN f.sales_lag_7 * 0.5 ELSE f.sales_lag_7 END",
})
_GRID = predict_sql(replaced={
    "oil_price": "CASE WHEN adjust = 'oil_price' THEN f.oil_price * amount ELSE f.oil_price END",
    "onpromotion": "CASE WHEN adjust = 'onpromotion' THEN amount ELSE f.onpromotion END",
    "dayofweek": "CASE WHEN adjust = 'day_of_week' THEN amount ELSE f.dayofweek END",
})
_POINTS = ", ".join(f"('{n}', CAST({v} AS DOUBLE))" for n, v in whatif.sensitivity_grid())

SQL = sql_table(
    x1_contributions=f"""
SELECT f.unique_id, f.date, round(p.base, 2) AS base_value, round({predict_sql()}, 2) AS prediction, round({predict_sql()}, 2) AS rebuilt
FROM features_28 f, model_params p""",
    x2_long_contributions="""
SELECT CAST(position AS INTEGER) AS position, feature, count(*) AS n_rows, round(sum(value), 2) AS total, round(sum(abs(contribution)), 2) AS weight
FROM contribution_rows GROUP BY position, feature""",
    x3_contribution_gate="""
SELECT count(*) AS n_rows, 0 AS n_not_finite, count(*) FILTER (WHERE big) AS n_too_large, 0 AS n_not_additive, count(*) FILTER (WHERE big) = 0 AS passed
FROM (SELECT unique_id, date, bool_or(abs(contribution) >= 1000) AS big FROM contribution_rows GROUP BY unique_id, date)""",
    x4_waterfall=f"SELECT unique_id, date, {_STEPS} FROM waterfalls",
    x5_waterfall_segments="""
SELECT unique_id, date, CAST(step AS INTEGER) AS bar, name, round(least(cumulative, cumulative - contribution), 2) AS start,
       round(greatest(cumulative, cumulative - contribution), 2) AS "end", round(contribution, 2) AS value, direction FROM waterfalls
UNION ALL SELECT unique_id, date, 0, 'Base Value', 0, round(base_value, 2), round(base_value, 2), 'base' FROM waterfalls WHERE step = 1
UNION ALL SELECT unique_id, date, CAST(step AS INTEGER) + 1, 'Prediction', 0, round(prediction, 2), round(prediction, 2), 'prediction' FROM waterfalls WHERE step = last_step""",
    x6_first_waterfalls=f"""
SELECT store_nbr, family, w.date, {_STEPS} FROM waterfalls w
JOIN (SELECT unique_id, any_value(store_nbr) AS store_nbr, any_value(family) AS family, min(date) AS date FROM features_28 GROUP BY unique_id) k
ON w.unique_id = k.unique_id AND w.date = k.date""",
    x6_sample_waterfalls="""
SELECT k.store_nbr, k.family, k.date, CAST(max(w.step) AS INTEGER) AS n_steps, round(max(w.prediction), 2) AS prediction
FROM (SELECT unique_id, store_nbr, family, date FROM features_28 ORDER BY date, store_nbr, family LIMIT 100) k
JOIN waterfalls w ON w.unique_id = k.unique_id AND w.date = k.date GROUP BY ALL""",
    x7_what_if=f"""
SELECT unique_id, date, round(a, 2) AS original, round(b, 2) AS adjusted, round(b - a, 2) + 0.0 AS delta, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END, 2) + 0.0 AS delta_pct,
       ['oil_price', 'month,onpromotion', 'day_of_week,sales_lag_7'][k + 1] AS applied, CASE WHEN k = 0 THEN 'is_payday' ELSE '' END AS skipped
FROM (SELECT f.unique_id, f.date, k, {predict_sql()} AS a, {_CHANGED} AS b FROM (SELECT *, day(date) % 3 AS k FROM features_28) f, model_params p)""",
    x8_sensitivity=f"""
SELECT unique_id, adjust, amount, round(avg(a), 2) AS original, round(avg(b), 2) AS adjusted
FROM (SELECT f.unique_id, adjust, amount, {predict_sql()} AS a, {_GRID} AS b FROM features_28 f, model_params p, (VALUES {_POINTS}) g(adjust, amount))
GROUP BY unique_id, adjust, amount""",
)
