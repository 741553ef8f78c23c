"""Error metrics, bands, accuracy summaries, gates and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mae, mape, rmse, rmsle
from ..operators import evaluate, gates, hierarchy, intervals, linear, requests, windows
from . import base
from .base import LINEAR_FEATURES, define, predict_sql, r, rounded, sql_table

Y, P = "sales", "sales_rolling_mean_28"
METRIC_NAMES = ("rmsle", "rmse", "mae", "mape")


def predictions(spark, sf_dir) -> DataFrame:
    """Three simple models of the same rows in long form: model, unique_id, date, y, y_hat."""
    models = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(col).alias("y_hat"))
          for name, col in (("last_week", "sales_lag_7"), ("mean_7", "sales_rolling_mean_7"), ("mean_28", P))]
    )
    return base.staged_features(spark, sf_dir).select("unique_id", "store_nbr", "family", "date", F.col(Y).alias("y"), F.inline(models))


define("predictions", " UNION ALL ".join(
    f"SELECT unique_id, store_nbr, family, date, sales AS y, '{name}' AS model, {col} AS y_hat FROM features_28"
    for name, col in (("last_week", "sales_lag_7"), ("mean_7", "sales_rolling_mean_7"), ("mean_28", P))
))


def metrics_sql(y: str = "y", p: str = "y_hat", places: int = 4) -> str:
    return f"""round(sqrt(avg(pow(ln(1 + greatest({y}, 0)) - ln(1 + greatest({p}, 0)), 2))), {places}) AS rmsle,
       round(sqrt(avg(pow({y} - {p}, 2))), {places}) AS rmse, round(avg(abs({y} - {p})), {places}) AS mae,
       round(avg(abs({y} - {p}) / (abs({y}) + 1)), {places}) AS mape, count({y} + {p}) AS n_samples"""


def _single(metric):
    def query(spark, sf_dir):
        value = metric(F.col(Y), F.col(P))
        return base.staged_features(spark, sf_dir).groupBy("store_nbr").agg(r(value, 4).alias("value"))

    return query


def a5_metrics(spark, sf_dir):
    return rounded(evaluate.metrics(predictions(spark, sf_dir), ["model", "family"]), 4, *METRIC_NAMES)


def _residual_offsets(spark, sf_dir) -> DataFrame:
    return intervals.interval_offsets(base.staged_features(spark, sf_dir), Y, P)


def a6_interval_offsets(spark, sf_dir):
    offsets = _residual_offsets(spark, sf_dir)
    return rounded(offsets, 3, *[c for c in offsets.columns if c != "n_samples"])


def a7_intervals(spark, sf_dir):
    rows = base.staged_features(spark, sf_dir).select("unique_id", "date", F.col("sales_lag_7").alias("prediction"))
    return rounded(intervals.apply_intervals(rows, _residual_offsets(spark, sf_dir)), 3, *intervals.BANDS)


def _daily(spark, sf_dir) -> DataFrame:
    return evaluate.daily_accuracy(base.staged_features(spark, sf_dir), Y, "sales_lag_7")


DAILY = ("actual", "predicted", "error", "mape")


def a9_daily_accuracy(spark, sf_dir):
    return rounded(_daily(spark, sf_dir), 2, *DAILY)


def a10_accuracy_summary(spark, sf_dir):
    summary = evaluate.calibration(evaluate.accuracy_summary(windows.thin(_daily(spark, sf_dir), 100)))
    return rounded(rounded(summary, 2, "mean_actual", "mean_predicted", "mean_error", "mean_mape"), 6, "correlation")


def a11_error_band(spark, sf_dir):
    return rounded(evaluate.error_band(_daily(spark, sf_dir)), 2, *DAILY, "error_upper", "error_lower")


def a12_series_profile(spark, sf_dir):
    columns = ("sales_lag_7", "sales_rolling_std_28", "oil_price", "promo_rolling_7")
    return rounded(requests.series_profile(base.staged_features(spark, sf_dir), columns), 3, *columns)


def _points(spark, sf_dir) -> DataFrame:
    """History before 2001 and forecasts from then on, per series."""
    rows = base.staged_features(spark, sf_dir)
    border = F.lit("2001-01-01").cast("date")
    past = rows.where(F.col("date") < border).select("unique_id", "date", F.col(Y).alias("actual"))
    p = F.col("sales_lag_7")
    future = rows.where(F.col("date") >= border).select(
        "unique_id", "date", p.alias("forecast"), (p - 1000).alias("lower_80"), (p + 1000).alias("upper_80"),
        (p - 2000).alias("lower_95"), (p + 2000).alias("upper_95"),
    )
    return requests.forecast_series(past, future, ["unique_id"])


def l5_forecast_series(spark, sf_dir):
    return _points(spark, sf_dir)


def l6_transition_date(spark, sf_dir):
    return requests.transition_date(_points(spark, sf_dir), ["unique_id"])


def a13_forecast_stats(spark, sf_dir):
    return rounded(evaluate.forecast_stats(_points(spark, sf_dir), ["unique_id"]), 6, "avg_actual", "avg_forecast", "min_forecast", "max_forecast", "trend_percent")


def a16_dimension_counts(spark, sf_dir):
    return hierarchy.dimension_counts(base.fact(spark, sf_dir, "nation"))


def a16_approx_dimension_counts(spark, sf_dir):
    return hierarchy.approx_dimension_counts(base.fact(spark, sf_dir, "nation"))


def contributions(spark, sf_dir) -> DataFrame:
    feats = base.staged_features(spark, sf_dir)
    return linear.linear_contributions(feats, linear.marginal_linear(feats, LINEAR_FEATURES))


def a17_feature_importance(spark, sf_dir):
    from ..operators.explain import explode_contributions

    long = explode_contributions(contributions(spark, sf_dir), ["unique_id", "date"])
    return rounded(evaluate.feature_importance(long), 3, "importance")


def s6_importance_csv(spark, sf_dir):
    from ..session import scratch_dir
    from ..sources.files import write_importance

    path = write_importance(a17_feature_importance(spark, sf_dir), scratch_dir(spark, "importance.csv"))
    return spark.read.option("header", True).schema("feature string, importance double").csv(path)


def _nodes(spark, sf_dir) -> DataFrame:
    rows = base.fact(spark, sf_dir, "nation").withColumnRenamed("date", "ds")
    return hierarchy.aggregate_levels(rows, "sales").withColumnRenamed("sales", "y_hat")


def _report_gates(spark, sf_dir) -> list[DataFrame]:
    feats = base.staged_features(spark, sf_dir)
    final = evaluate.metrics(feats, (), Y, P).select(F.col("rmsle").alias("final_rmsle"), F.lit(None).cast("double").alias("cv_rmsle"))
    return [
        gates.model_gate(final, 0.5),
        gates.data_gates(feats, 0.01, 1000, ("date", "store_nbr", "family", "sales")),
        gates.recon_gate(_nodes(spark, sf_dir), 0.01),
    ]


def a18_reconciliation_gate(spark, sf_dir):
    return rounded(gates.recon_gate(_nodes(spark, sf_dir), 0.01), 6, "value")


def a19_quality_report(spark, sf_dir):
    return rounded(gates.quality_report(*_report_gates(spark, sf_dir)), 6, "value")


def a20_model_gate(spark, sf_dir):
    return rounded(_report_gates(spark, sf_dir)[0], 6, "value")


def l3_leaderboard(spark, sf_dir):
    scores = evaluate.model_metrics(predictions(spark, sf_dir))
    return rounded(evaluate.leaderboard(scores, "rmsle"), 4, "rmsle", "improvement_percent")


def f14_model_metrics(spark, sf_dir):
    return rounded(evaluate.model_metrics(predictions(spark, sf_dir)), 4, *METRIC_NAMES)


def f13_prediction_match(spark, sf_dir):
    feats = base.staged_features(spark, sf_dir)
    exact = feats.select("unique_id", "date", F.col(P).alias("y_hat"))
    narrow = feats.select("unique_id", "date", (F.floor(F.col(P)) + 0.5).alias("y_hat"))
    return rounded(evaluate.compare_predictions(narrow, exact, ["unique_id", "date"]), 6, "max_abs_diff", "max_rel_diff")


QUERIES = {
    "a1_rmsle": _single(rmsle),
    "a2_rmse": _single(rmse),
    "a3_mae": _single(mae),
    "a4_mape": _single(mape),
    **{
        f.__name__: f
        for f in (
            a5_metrics, a6_interval_offsets, a7_intervals, a9_daily_accuracy, a10_accuracy_summary, a11_error_band,
            a12_series_profile, l5_forecast_series, l6_transition_date, a13_forecast_stats, a16_dimension_counts,
            a16_approx_dimension_counts, a17_feature_importance, s6_importance_csv, a18_reconciliation_gate,
            a19_quality_report, a20_model_gate, l3_leaderboard, f14_model_metrics, f13_prediction_match,
        )
    },
}

define("daily_totals", """
SELECT date, a AS actual, p AS predicted, a - p AS error, CASE WHEN a <> 0 THEN abs(a - p) / a * 100 END AS mape
FROM (SELECT date, sum(sales) AS a, sum(sales_lag_7) AS p FROM features_28 GROUP BY date)""")
define("mean_residuals", f"SELECT sales - {P} AS e FROM features_28")
define("mean_offsets", """
SELECT quantile_cont(e, 0.1) AS lower_80_offset, quantile_cont(e, 0.9) AS upper_80_offset, quantile_cont(e, 0.025) AS lower_95_offset,
       quantile_cont(e, 0.975) AS upper_95_offset, stddev_pop(e) AS std, avg(abs(e)) AS mean_abs_error, count(e) AS n_samples FROM mean_residuals""")
define("points", """
SELECT unique_id, date, CASE WHEN date < DATE '2001-01-01' THEN sales END AS actual, CASE WHEN date >= DATE '2001-01-01' THEN sales_lag_7 END AS forecast
FROM features_28""")
define("nation_nodes", """
SELECT date AS ds, CASE WHEN store_nbr IS NULL THEN 'Total' ELSE 'Store' END AS level, sum(sales) AS v
FROM fact_nation GROUP BY GROUPING SETS ((date), (date, store_nbr))""")
define("contribution_rows", " UNION ALL ".join(
    f"SELECT f.unique_id, f.date, p.base AS base_value, {i} AS position, '{c}' AS feature, CAST(f.{c} AS DOUBLE) AS value, p.b_{c} * (f.{c} - p.m_{c}) AS contribution FROM features_28 f, model_params p"
    for i, c in enumerate(LINEAR_FEATURES)
))
define("importance", "SELECT feature, round(avg(abs(contribution)), 3) AS importance FROM contribution_rows GROUP BY feature")
define("gate_model", f"""
SELECT 'model_rmsle' AS gate, v AS value, CAST(0.5 AS DOUBLE) AS threshold, v < 0.5 AS passed, CAST(NULL AS VARCHAR) AS note
FROM (SELECT sqrt(avg(pow(ln(1 + sales) - ln(1 + {P}), 2))) AS v FROM features_28)""")
define("gate_recon", """
SELECT 'reconciliation' AS gate, abs(t - s) / t AS value, CAST(0.01 AS DOUBLE) AS threshold, abs(t - s) / t < 0.01 AS passed, CAST(NULL AS VARCHAR) AS note
FROM (SELECT sum(v) FILTER (WHERE level = 'Total') AS t, sum(v) FILTER (WHERE level = 'Store') AS s FROM nation_nodes)""")
define("gate_data", """
SELECT unnest(['data_null_ratio', 'data_row_count', 'required_columns']) AS gate, unnest([0.0, n, 0.0]) AS value,
       unnest([0.01, 1000.0, 0.0]) AS threshold, unnest([true, n >= 1000, true]) AS passed, CAST(NULL AS VARCHAR) AS note
FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM features_28)""")


def _one(name: str) -> str:
    expressions = {
        "rmsle": f"sqrt(avg(pow(ln(1 + {Y}) - ln(1 + {P}), 2)))", "rmse": f"sqrt(avg(pow({Y} - {P}, 2)))",
        "mae": f"avg(abs({Y} - {P}))", "mape": f"avg(abs({Y} - {P}) / (abs({Y}) + 1))",
    }
    return f"SELECT store_nbr, round({expressions[name]}, 4) AS value FROM features_28 GROUP BY store_nbr"


_BANDS = ", ".join(
    f"round({'greatest(0, p.sales_lag_7 + o.%s)' % (b + '_offset') if b.startswith('lower') else 'p.sales_lag_7 + o.%s_offset' % b}, 3) AS {b}"
    for b in intervals.BANDS
)
SQL = sql_table(
    a1_rmsle=_one("rmsle"), a2_rmse=_one("rmse"), a3_mae=_one("mae"), a4_mape=_one("mape"),
    a5_metrics=f"SELECT model, family, {metrics_sql()} FROM predictions GROUP BY model, family",
    a6_interval_offsets="""
SELECT round(lower_80_offset, 3) AS lower_80_offset, round(upper_80_offset, 3) AS upper_80_offset, round(lower_95_offset, 3) AS lower_95_offset,
       round(upper_95_offset, 3) AS upper_95_offset, round(std, 3) AS std, round(mean_abs_error, 3) AS mean_abs_error, n_samples FROM mean_offsets""",
    a7_intervals=f"SELECT p.unique_id, p.date, p.sales_lag_7 AS prediction, {_BANDS} FROM features_28 p, mean_offsets o",
    a9_daily_accuracy="SELECT date, round(actual, 2) AS actual, round(predicted, 2) AS predicted, round(error, 2) AS error, round(mape, 2) AS mape FROM daily_totals",
    a10_accuracy_summary="""
SELECT count(*) AS data_points, round(avg(actual), 2) AS mean_actual, round(avg(predicted), 2) AS mean_predicted, round(avg(error), 2) AS mean_error,
       round(avg(mape), 2) AS mean_mape, round(corr(actual, predicted), 6) AS correlation,
       CASE WHEN avg(error) > 0 THEN 'over' WHEN avg(error) < 0 THEN 'under' ELSE 'accurate' END AS calibration
FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM daily_totals) WHERE rn % greatest(1, n // 100) = 0""",
    a11_error_band="""
SELECT date, round(actual, 2) AS actual, round(predicted, 2) AS predicted, round(error, 2) AS error, round(mape, 2) AS mape,
       round(predicted + abs(error), 2) AS error_upper, round(predicted - abs(error), 2) AS error_lower FROM daily_totals""",
    a12_series_profile="""
SELECT store_nbr, family, round(avg(coalesce(sales_lag_7, 0)), 3) AS sales_lag_7, round(avg(coalesce(sales_rolling_std_28, 0)), 3) AS sales_rolling_std_28,
       round(avg(coalesce(oil_price, 0)), 3) AS oil_price, round(avg(coalesce(promo_rolling_7, 0)), 3) AS promo_rolling_7 FROM features_28 GROUP BY store_nbr, family""",
    l5_forecast_series="""
SELECT *, forecast - 1000 AS lower_80, forecast + 1000 AS upper_80, forecast - 2000 AS lower_95, forecast + 2000 AS upper_95 FROM points""",
    l6_transition_date="""
SELECT unique_id, max(date) FILTER (WHERE date < f) AS transition_date
FROM (SELECT *, min(date) FILTER (WHERE actual IS NULL AND forecast IS NOT NULL) OVER (PARTITION BY unique_id) AS f FROM points) GROUP BY unique_id""",
    a13_forecast_stats="""
SELECT unique_id, round(a, 6) AS avg_actual, round(f, 6) AS avg_forecast, round(lo, 6) AS min_forecast, round(hi, 6) AS max_forecast,
       CASE WHEN f > a THEN 'up' WHEN f < a THEN 'down' ELSE 'stable' END AS trend, round(CASE WHEN a > 0 THEN abs((f - a) / a) * 100 ELSE 0 END, 6) AS trend_percent
FROM (SELECT unique_id, coalesce(avg(actual), 0) AS a, coalesce(avg(forecast), 0) AS f, min(forecast) AS lo, max(forecast) AS hi FROM points GROUP BY unique_id)""",
    a16_dimension_counts="""
SELECT count(DISTINCT store_nbr) AS n_stores, count(DISTINCT family) AS n_families, count(DISTINCT (store_nbr, family)) AS n_series FROM fact_nation""",
    a17_feature_importance="SELECT * FROM importance",
    s6_importance_csv="SELECT * FROM importance",
    a18_reconciliation_gate="SELECT gate, round(value, 6) AS value, threshold, passed, note FROM gate_recon",
    a19_quality_report="""
SELECT gate, round(value, 6) AS value, threshold, passed, note, bool_and(passed) OVER () AS all_passed
FROM (SELECT * FROM gate_model UNION ALL SELECT * FROM gate_data UNION ALL SELECT * FROM gate_recon)""",
    a20_model_gate="SELECT gate, round(value, 6) AS value, threshold, passed, note FROM gate_model",
    l3_leaderboard="""
SELECT model, round(v, 4) AS rmsle, row_number() OVER (ORDER BY v) AS position, row_number() OVER (ORDER BY v) = 1 AS is_best,
       row_number() OVER (ORDER BY v DESC) = 1 AS is_worst, round((max(v) OVER () - min(v) OVER ()) / max(v) OVER () * 100, 4) AS improvement_percent
FROM (SELECT model, sqrt(avg(pow(ln(1 + y) - ln(1 + y_hat), 2))) AS v FROM predictions GROUP BY model)""",
    f14_model_metrics=f"SELECT model, {metrics_sql()} FROM predictions GROUP BY model",
    f13_prediction_match=f"""
SELECT count(*) AS n_rows, bool_and(abs(a - b) <= 1e-5 + 1e-3 * abs(b)) AS all_close, round(max(abs(a - b)), 6) AS max_abs_diff,
       round(max(abs(a - b) / (abs(b) + 1e-8)), 6) AS max_rel_diff
FROM (SELECT floor({P}) + 0.5 AS a, {P} AS b FROM features_28)""",
)
