"""Splits, back-tests, forecasters and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, foldmodels, forecast, linear, model, split
from ..operators.requests import sample_rows
from ..plans.backtest import naive_holdout
from ..session import scratch_dir
from ..sources import sample
from ..sources.stages import materialised
from . import base
from .accuracy import METRIC_NAMES, metrics_sql
from .base import LINEAR_FEATURES, define, predict_sql, r, rounded, sql_table

H = 14
TWO_INPUTS = ("sales_rolling_mean_28", "onpromotion")


def f1_time_split(spark, sf_dir):
    train, valid = split.time_split(base.fact(spark, sf_dir), 90)
    sides = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last")).select(F.lit(name).alias("side"), "*")
        for name, df in (("train", train), ("valid", valid))
    ]
    return sides[0].unionByName(sides[1])


def f2_fold_table(spark, sf_dir):
    return split.folds(base.fact(spark, sf_dir), n_splits=80)


def f2_walk_forward(spark, sf_dir):
    rows = split.walk_forward(base.fact(spark, sf_dir), gap_days=30)
    return rows.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"), r(F.sum("sales"), 2).alias("sales")
    )


def _cv(spark, sf_dir):
    rows = split.walk_forward(base.series(spark, sf_dir), date="ds")
    return split.cross_validate(forecast.naive_forecaster(), rows)


def f3_cv_folds(spark, sf_dir):
    per_fold, _ = _cv(spark, sf_dir)
    return rounded(per_fold, 4, *METRIC_NAMES)


def f3_cv_pooled(spark, sf_dir):
    _, pooled = _cv(spark, sf_dir)
    return rounded(pooled, 4, *METRIC_NAMES, "mean_rmsle", "std_rmsle")


def f4_seasonal_naive(spark, sf_dir):
    return forecast.seasonal_naive(base.series(spark, sf_dir), H)


def f5_smoothing_fixed(spark, sf_dir):
    flat = forecast.ets(base.series(spark, sf_dir), H, alphas=(0.3,))
    return rounded(flat.select("unique_id", "ds", "y_hat"), 3, "y_hat")


def f5_smoothing_grid(spark, sf_dir):
    return forecast.ets(base.series(spark, sf_dir), H, m=7)


def f6_forecast_all_naive(spark, sf_dir):
    return rounded(forecast.forecast_all(base.series(spark, sf_dir), 21, models=("SeasonalNaive",)), 3, "lo", "hi")


def f6_forecast_all(spark, sf_dir):
    return forecast.forecast_all(base.series(spark, sf_dir), H)


def f7_rolling_origin(spark, sf_dir):
    scored = forecast.cv_series(base.series(spark, sf_dir), forecast.naive_forecaster(), H)
    return rounded(evaluate.metrics(scored, ["fold"]), 4, *METRIC_NAMES)


def f7_rolling_origin_ets(spark, sf_dir):
    scored = forecast.cv_series(base.series(spark, sf_dir), forecast.ets_forecaster(), H)
    return evaluate.metrics(scored, ["fold"])


def _sides(spark, sf_dir):
    return split.time_split(base.staged_features(spark, sf_dir), 90)


def f8_trained_cv(spark, sf_dir):
    """Walk-forward cross-validation of a model that is trained anew in each fold."""
    feats = base.staged_features(spark, sf_dir)
    rows = materialised(split.walk_forward(feats), "cv_rows")  # read twice for each fold
    scored = model.trained_forecaster(lambda train, valid: model.fit_linear(train), split.folds(feats.select("date")))(rows)
    near = F.abs(F.avg("y_hat") - F.avg("y")) <= 0.5 * F.avg("y")
    finite = F.bool_and(F.col("y_hat").isNotNull() & ~F.isnan("y_hat") & (F.abs("y_hat") < float("inf")))
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), finite.alias("finite"), near.alias("mean_within_half"))


def _fold_rows(spark, sf_dir):
    return materialised(split.walk_forward(base.staged_features(spark, sf_dir)), "cv_rows")


def f3_trained_cv_folds(spark, sf_dir):
    """Errors of a least-squares model of two inputs, trained anew in each fold."""
    per_fold, _ = split.cross_validate(foldmodels.fold_forecaster(TWO_INPUTS), _fold_rows(spark, sf_dir))
    return rounded(per_fold, 4, *METRIC_NAMES)


def f3_trained_cv_pooled(spark, sf_dir):
    _, pooled = split.cross_validate(foldmodels.fold_forecaster(TWO_INPUTS), _fold_rows(spark, sf_dir))
    return rounded(pooled, 4, *METRIC_NAMES, "mean_rmsle", "std_rmsle")


def f9_fold_coefficients(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir).where(F.col("role") == split.TRAIN)
    fitted = foldmodels.fit_groups(rows, ["fold"], TWO_INPUTS)
    slopes = [r(F.col("betas")[i], 5).alias(f"slope_{i + 1}") for i in range(2)]
    means = [r(F.col("means")[i], 4).alias(f"mean_{i + 1}") for i in range(2)]
    return fitted.select("fold", "n", r(F.col("base"), 4).alias("base"), *slopes, *means)


def f9_fold_normal_equations(spark, sf_dir):
    """All numeric inputs, a model per fold: residuals of the training rows have mean 0 and no correlation with any input."""
    rows = _fold_rows(spark, sf_dir).where(F.col("role") == split.TRAIN)
    inputs, _ = model.available(rows)
    scored = foldmodels.score_groups(rows, materialised(foldmodels.fit_groups(rows, ["fold"], inputs), "fold_models"), ["fold"], inputs)
    left = scored.withColumn("_left", F.col("sales") - F.col("prediction"))

    def free(name):
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.abs(F.covar_pop("_left", x)) <= 1e-6 * F.stddev_pop("sales") * F.stddev_pop(x) + 1e-12

    every = [free(c) for c in inputs]
    return left.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.abs(F.avg("_left")) <= 1e-6 * F.stddev_pop("sales")).alias("no_bias"),
        F.forall(F.array(*every), lambda ok: ok).alias("orthogonal"))


def f8_boosted_trees(spark, sf_dir):
    train, valid = _sides(spark, sf_dir)
    fitted = model.fit_gbt(train, valid, rounds=8, depth=4, step=0.3, tol=0.001)
    return evaluate.metrics(model.score(fitted, valid), ["family"], "sales", "prediction")


def f8_tree_importances(spark, sf_dir):
    train, valid = _sides(spark, sf_dir)
    return model.tree_importances(spark, model.fit_gbt(train, valid, rounds=3, depth=3, step=0.3))


def f9_linear_baseline(spark, sf_dir):
    train, valid = _sides(spark, sf_dir)
    return evaluate.metrics(model.score(model.fit_linear(train), valid), ["family"], "sales", "prediction")


def f9_single_feature_lines(spark, sf_dir):
    y, x = F.col("sales"), F.col("sales_rolling_mean_28")
    return base.staged_features(spark, sf_dir).groupBy("family").agg(
        r(F.regr_slope(y, x), 6).alias("slope"), r(F.regr_intercept(y, x), 3).alias("intercept"), r(F.regr_r2(y, x), 6).alias("r2")
    )


def f10_linear_scores(spark, sf_dir):
    feats = base.staged_features(spark, sf_dir)
    scored = linear.score_linear(feats, linear.marginal_linear(feats, LINEAR_FEATURES))
    return scored.select("unique_id", "date", r(F.col("prediction"), 2).alias("prediction"))


def f10_model_vectors(spark, sf_dir):
    """The model vector of each row: 25 numbers and two category codes, fitted once."""
    feats = base.staged_features(spark, sf_dir, 90)
    coded = model.vector_columns(model.encode(feats, model.fit_encoder(feats)))
    slot = {"year": 0, "oil": 7, "lag_90": 16, "family": 25, "type": 26}
    return coded.select(
        "unique_id", "date", F.size("features").alias("n"), *[F.col("features")[i].cast("double").alias(c) for c, i in slot.items()]
    )


def f12_saved_model(spark, sf_dir):
    train, valid = _sides(spark, sf_dir)
    fitted = model.fit_linear(train)
    again = model.load(model.save(fitted, scratch_dir(spark, "model")))
    keys = ["unique_id", "date"]
    return evaluate.compare_predictions(model.score(fitted, valid), model.score(again, valid), keys, "prediction")


def l7_sampled_rows(spark, sf_dir):
    return sample_rows(base.staged_features(spark, sf_dir).select("unique_id", "date", "sales"), 1000, ["unique_id", "date"])


def naive_holdout_by_family(spark, sf_dir):
    scored = naive_holdout(base.fact(spark, sf_dir), sample.external(spark, sf_dir), horizon=28, days=90)
    return rounded(scored, 4, *METRIC_NAMES)


QUERIES = {
    f.__name__: f
    for f in (
        f1_time_split, f2_fold_table, f2_walk_forward, f3_cv_folds, f3_cv_pooled, f4_seasonal_naive, f5_smoothing_fixed,
        f5_smoothing_grid, f6_forecast_all_naive, f6_forecast_all, f7_rolling_origin, f7_rolling_origin_ets, f8_boosted_trees,
        f3_trained_cv_folds, f3_trained_cv_pooled, f9_fold_coefficients, f9_fold_normal_equations, f8_trained_cv, f8_tree_importances, f9_linear_baseline, f9_single_feature_lines, f10_linear_scores, f10_model_vectors, f12_saved_model, l7_sampled_rows,
        naive_holdout_by_family,
    )
}


def _folds(n: int, gap: int = 0, source: str = "fact_region") -> str:
    return f"""
SELECT row_number() OVER (ORDER BY i) AS fold, * FROM (
  SELECT i, valid_end - 90 - {gap} - 365 AS train_start, valid_end - 90 - {gap} AS train_end, valid_end - 90 AS valid_start, valid_end, mn
  FROM (SELECT i, mn, mx - CAST(i * 30 AS INTEGER) AS valid_end FROM (SELECT max(date) AS mx, min(date) AS mn FROM {source}), range({n}) t(i))) b
WHERE train_start >= mn AND EXISTS (SELECT 1 FROM {source} f WHERE f.date >= b.train_start AND f.date < b.train_end)
  AND EXISTS (SELECT 1 FROM {source} f WHERE f.date BETWEEN b.valid_start AND b.valid_end)"""


define("folds_many", _folds(80))
define("folds_gap", _folds(3, 30))
define("folds_plain", _folds(3))
define("folds_features", _folds(3, source="features_28"))
define("folds_series", """
SELECT fold, unique_id, max(ds) FILTER (WHERE role = 'train') OVER (PARTITION BY fold, unique_id) AS last_ds, ds, y, role
FROM (SELECT b.fold, s.unique_id, s.ds, s.y, CASE WHEN s.ds < b.train_end THEN 'train' ELSE 'valid' END AS role
      FROM series_region s JOIN folds_plain b ON s.ds >= b.train_start AND s.ds <= b.valid_end)""")
define("origin_series", f"""
SELECT unique_id, ds, y, fold, CASE WHEN ds <= cutoff THEN 'train' ELSE 'valid' END AS role,
       max(ds) FILTER (WHERE ds <= cutoff) OVER (PARTITION BY fold, unique_id) AS last_ds
FROM (SELECT s.*, i AS fold, e - {H} - CAST((3 - i) * 30 AS INTEGER) AS cutoff
      FROM (SELECT *, max(ds) OVER (PARTITION BY unique_id) AS e FROM series_region) s, range(1, 4) t(i)) WHERE ds <= cutoff + {H}""")
define("holdout_series", """
SELECT 1 AS fold, unique_id, ds, y, role, family, max(ds) FILTER (WHERE role = 'train') OVER (PARTITION BY unique_id) AS last_ds
FROM (SELECT unique_id, date AS ds, sales AS y, family, CASE WHEN date < (SELECT max(date) - 90 FROM features_28) THEN 'train' ELSE 'valid' END AS role
      FROM features_28)""")


def _naive(rows: str, columns: str = "v.fold, v.unique_id, v.ds, v.y") -> str:
    """Seasonal naive predictions of the valid rows of a fold frame."""
    return f"""
SELECT {columns}, t.y AS y_hat FROM {rows} v JOIN (
  SELECT *, row_number() OVER (PARTITION BY fold, unique_id, phase ORDER BY ds DESC) AS back, max(k) OVER (PARTITION BY fold, unique_id) AS n
  FROM (SELECT *, dense_rank() OVER (PARTITION BY fold, unique_id ORDER BY phase) AS k
        FROM (SELECT *, (ds - DATE '1970-01-01') % 7 AS phase FROM {rows} WHERE role = 'train'))) t
ON v.fold = t.fold AND v.unique_id = t.unique_id AND t.n = 7 AND t.back = 1 AND (v.ds - DATE '1970-01-01') % 7 = t.phase
WHERE v.role = 'valid'"""


define("cv_scored", _naive("folds_series"))
define("fold_lines", """
SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
FROM (SELECT b.fold, count(*) AS n, avg(sales) AS base, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
             covar_pop(x1, x2) AS s12, covar_pop(x1, sales) AS s1y, covar_pop(x2, sales) AS s2y
      FROM (SELECT date, sales, coalesce(sales_rolling_mean_28, 0) AS x1, CAST(onpromotion AS DOUBLE) AS x2 FROM features_28) f
      JOIN folds_features b ON f.date >= b.train_start AND f.date < b.train_end GROUP BY b.fold)""")
define("fold_line_scored", """
SELECT l.fold, f.sales AS y, l.base + l.b1 * (coalesce(f.sales_rolling_mean_28, 0) - l.m1) + l.b2 * (f.onpromotion - l.m2) AS y_hat
FROM features_28 f JOIN folds_features b ON f.date BETWEEN b.valid_start AND b.valid_end JOIN fold_lines l ON l.fold = b.fold""")
define("origin_scored", _naive("origin_series"))
define("holdout_scored", _naive("holdout_series", "v.fold, v.unique_id, v.ds, v.y, v.family"))
define("naive_ahead", """
SELECT t.unique_id, CAST(t.last_ds + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, t.y AS y_hat
FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, phase ORDER BY ds DESC) AS back, max(ds) OVER (PARTITION BY unique_id) AS last_ds,
             max(k) OVER (PARTITION BY unique_id) AS n
      FROM (SELECT *, dense_rank() OVER (PARTITION BY unique_id ORDER BY phase) AS k
            FROM (SELECT *, (ds - DATE '1970-01-01') % 7 AS phase FROM series_region))) t
JOIN range(1, 22) s(step) ON t.back = 1 AND (t.last_ds + CAST(step AS INTEGER) - DATE '1970-01-01') % 7 = t.phase WHERE n = 7""")

SQL = sql_table(
    f1_time_split="""
SELECT CASE WHEN date < (SELECT max(date) - 90 FROM fact_region) THEN 'train' ELSE 'valid' END AS side, count(*) AS n_rows, min(date) AS first, max(date) AS last
FROM fact_region GROUP BY 1""",
    f2_fold_table="SELECT fold, train_start, train_end, valid_start, valid_end FROM folds_many",
    f2_walk_forward="""
SELECT fold, role, count(*) AS n_rows, min(date) AS first, max(date) AS last, round(sum(sales), 2) AS sales
FROM (SELECT b.fold, f.*, CASE WHEN f.date >= b.train_start AND f.date < b.train_end THEN 'train'
        WHEN f.date >= b.valid_start AND f.date <= b.valid_end THEN 'valid' END AS role FROM fact_region f, folds_gap b)
WHERE role IS NOT NULL GROUP BY fold, role""",
    f3_cv_folds=f"SELECT fold, {metrics_sql()} FROM cv_scored GROUP BY fold",
    f3_cv_pooled=f"""
SELECT {metrics_sql()}, (SELECT round(avg(v), 4) FROM (SELECT sqrt(avg(pow(ln(1 + y) - ln(1 + y_hat), 2))) AS v FROM cv_scored GROUP BY fold)) AS mean_rmsle,
       (SELECT round(stddev_pop(v), 4) FROM (SELECT sqrt(avg(pow(ln(1 + y) - ln(1 + y_hat), 2))) AS v FROM cv_scored GROUP BY fold)) AS std_rmsle,
       count(DISTINCT fold) AS n_splits FROM cv_scored""",
    f3_trained_cv_folds=f"SELECT fold, {metrics_sql()} FROM fold_line_scored GROUP BY fold",
    f3_trained_cv_pooled=f"""
SELECT {metrics_sql()}, count(DISTINCT fold) AS n_splits,
       (SELECT round(avg(rmsle), 4) FROM (SELECT {metrics_sql(places=12)} FROM fold_line_scored GROUP BY fold)) AS mean_rmsle,
       (SELECT round(stddev_pop(rmsle), 4) FROM (SELECT {metrics_sql(places=12)} FROM fold_line_scored GROUP BY fold)) AS std_rmsle
FROM fold_line_scored""",
    f9_fold_coefficients="""
SELECT fold, n, round(base, 4) AS base, round(b1, 5) AS slope_1, round(b2, 5) AS slope_2, round(m1, 4) AS mean_1, round(m2, 4) AS mean_2 FROM fold_lines""",
    f9_fold_normal_equations="""
SELECT b.fold, count(*) AS n_rows, true AS no_bias, true AS orthogonal
FROM features_28 f JOIN folds_features b ON f.date >= b.train_start AND f.date < b.train_end GROUP BY b.fold""",
    f4_seasonal_naive=f"SELECT * FROM naive_ahead WHERE step <= {H}",
    f5_smoothing_fixed=f"""
SELECT unique_id, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds, round(level, 3) AS y_hat
FROM (SELECT unique_id, max(ds) AS last_ds, sum(CASE WHEN k = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - k) END * y) AS level
      FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k, count(*) OVER (PARTITION BY unique_id) AS n FROM series_region)
      GROUP BY unique_id), range(1, {H + 1}) s(step)""",
    f6_forecast_all_naive="""
SELECT 'SeasonalNaive' AS model, a.unique_id, a.ds, a.y_hat, CAST(l.level AS INTEGER) AS level,
       round(a.y_hat - l.z * s.sigma * sqrt((a.step - 1) // 7 + 1), 3) AS lo, round(a.y_hat + l.z * s.sigma * sqrt((a.step - 1) // 7 + 1), 3) AS hi
FROM naive_ahead a JOIN (SELECT unique_id, sqrt(avg(pow(y - b, 2))) AS sigma
  FROM (SELECT *, lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds) AS b FROM series_region) GROUP BY unique_id) s USING (unique_id),
  (VALUES (80, CAST(1.2815515655446004 AS DOUBLE)), (95, CAST(1.959963984540054 AS DOUBLE))) l(level, z)""",
    f7_rolling_origin=f"SELECT fold, {metrics_sql()} FROM origin_scored GROUP BY fold",
    f8_trained_cv="""
SELECT b.fold, count(*) AS n_rows, true AS finite, true AS mean_within_half
FROM features_28 f JOIN folds_features b ON f.date BETWEEN b.valid_start AND b.valid_end GROUP BY b.fold""",
    f9_single_feature_lines="""
SELECT family, round(regr_slope(sales, sales_rolling_mean_28), 6) AS slope, round(regr_intercept(sales, sales_rolling_mean_28), 3) AS intercept,
       round(regr_r2(sales, sales_rolling_mean_28), 6) AS r2 FROM features_28 GROUP BY family""",
    f10_linear_scores=f"SELECT f.unique_id, f.date, round({predict_sql()}, 2) AS prediction FROM features_28 f, model_params p",
    f10_model_vectors="""
SELECT unique_id, date, 27 AS n, CAST(year AS DOUBLE) AS year, CAST(CAST(oil_price AS FLOAT) AS DOUBLE) AS oil, CAST(CAST(sales_lag_90 AS FLOAT) AS DOUBLE) AS lag_90,
       CAST(dense_rank() OVER (ORDER BY family) - 1 AS DOUBLE) AS family, CAST(dense_rank() OVER (ORDER BY type) - 1 AS DOUBLE) AS type FROM features_90""",
    naive_holdout_by_family=f"SELECT family, {metrics_sql()} FROM holdout_scored GROUP BY family",
)
