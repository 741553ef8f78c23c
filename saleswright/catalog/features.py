"""Joins with side tables, lags, rolling windows and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, windows
from ..plans.features import build_feature_matrix
from ..sources import sample
from . import base
from .base import PROMO_SQL, define, lags_sql, r, rolling_sql, rounded, sql_table

ROLLING = (7, 14, 28, 90)


def _rounded_rolling(df):
    return rounded(df, 4, *[c for c in df.columns if "rolling_mean" in c or "rolling_std" in c])


def j1_oil(spark, sf_dir):
    return enrich.join_oil(base.fact(spark, sf_dir), sample.oil(spark, sf_dir))


def j2_stores(spark, sf_dir):
    return enrich.join_stores(base.fact(spark, sf_dir), sample.stores(spark, sf_dir))


def j3_holidays(spark, sf_dir):
    return enrich.join_holidays(base.fact(spark, sf_dir), sample.holidays(spark, sf_dir))


def j4_enriched(spark, sf_dir):
    return base.enriched(spark, sf_dir)


def w1_lags(spark, sf_dir):
    return windows.add_lags(base.fact(spark, sf_dir))


def w2_rolling(spark, sf_dir):
    return _rounded_rolling(windows.add_rolling(base.fact(spark, sf_dir)))


def w4_promotions(spark, sf_dir):
    raw = base.fact(spark, sf_dir).withColumn("onpromotion", F.when(F.dayofmonth("date") != 9, F.col("onpromotion")))
    return windows.promo_features(raw)


def w5_forward_fill(spark, sf_dir):
    return enrich.forward_fill(sample.oil(spark, sf_dir), "dcoilwtico", out="oil_price")


def w6_feature_matrix(spark, sf_dir):
    return _rounded_rolling(base.features(spark, sf_dir, 90))


def w6_feature_matrix_short(spark, sf_dir):
    return _rounded_rolling(base.features(spark, sf_dir, 28))


def w6_feature_matrix_year_blocks(spark, sf_dir):
    return _rounded_rolling(build_feature_matrix(base.enriched(spark, sf_dir), 90, year_blocks=True))


def w8_thinned_days(spark, sf_dir):
    daily = base.fact(spark, sf_dir).groupBy("date").agg(r(F.sum("sales"), 2).alias("actual"))
    return windows.thin(daily, 100)


def w9_monthly_trend(spark, sf_dir):
    months = base.fact(spark, sf_dir).groupBy("store_nbr", "family", F.trunc("date", "month").alias("month")).agg(
        F.round(F.sum("sales"), 2).alias("prediction")
    )
    return rounded(windows.with_trend(months, ["store_nbr", "family"], "month"), 4, "trend_percent")


def w10_share_of_parent(spark, sf_dir):
    nodes = base.fact(spark, sf_dir, "nation").groupBy("store_nbr", "family").agg(F.round(F.sum("sales"), 2).alias("prediction"))
    return rounded(windows.share_of_parent(nodes, ["store_nbr"]), 4, "share_percent")


QUERIES = {
    f.__name__: f
    for f in (
        j1_oil, j2_stores, j3_holidays, j4_enriched, w1_lags, w2_rolling, w4_promotions, w5_forward_fill, w6_feature_matrix,
        w6_feature_matrix_short, w6_feature_matrix_year_blocks, w8_thinned_days, w9_monthly_trend, w10_share_of_parent,
    )
}

define("raw_promotions", "SELECT date, store_nbr, family, sales, CASE WHEN day(date) <> 9 THEN onpromotion END AS onpromotion FROM fact_region")


def _matrix(horizon: int) -> str:
    names = [f"sales_rolling_{k}_{n}" for k in ("mean", "std") for n in dict.fromkeys((7, 14, 28, horizon))]
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 4) AS {n}' for n in names)}) FROM features_{horizon}"


SQL = sql_table(
    j1_oil="SELECT * FROM fact_oil",
    j2_stores="SELECT * FROM fact_region LEFT JOIN store_list USING (store_nbr)",
    j3_holidays="""
SELECT f.*, CAST(coalesce(h.is_holiday, 0) AS INTEGER) AS is_holiday FROM fact_region f
LEFT JOIN (SELECT DISTINCT date, 1 AS is_holiday FROM holiday_list WHERE locale = 'National') h USING (date)""",
    j4_enriched="SELECT * FROM enriched",
    w1_lags=f"SELECT *, {lags_sql((1, 7, 14, 28, 90))} FROM fact_region WINDOW series AS (PARTITION BY store_nbr, family ORDER BY date)",
    w2_rolling=f"SELECT * REPLACE ({', '.join(f'round(sales_rolling_{k}_{n}, 4) AS sales_rolling_{k}_{n}' for k in ('mean', 'std') for n in ROLLING)})"
    f" FROM (SELECT *, {rolling_sql(ROLLING)} FROM fact_region)",
    w4_promotions=f"""
SELECT * REPLACE (coalesce(onpromotion, 0) AS onpromotion) FROM (SELECT *, {PROMO_SQL} FROM raw_promotions
  WINDOW promo AS (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
    w5_forward_fill="SELECT q.*, f.oil_price FROM oil_quotes q JOIN oil_filled f USING (date)",
    w6_feature_matrix=_matrix(90),
    w6_feature_matrix_short=_matrix(28),
    w6_feature_matrix_year_blocks=_matrix(90),
    w8_thinned_days="""
SELECT date, actual FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n
  FROM (SELECT date, round(sum(sales), 2) AS actual FROM fact_region GROUP BY date)) WHERE rn % greatest(1, n // 100) = 0""",
    w9_monthly_trend="""
SELECT *, round(CASE WHEN previous_prediction = 0 THEN 0 ELSE (prediction - previous_prediction) / previous_prediction * 100 END, 4) AS trend_percent
FROM (SELECT *, lag(prediction) OVER (PARTITION BY store_nbr, family ORDER BY month) AS previous_prediction
  FROM (SELECT store_nbr, family, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(sales), 2) AS prediction FROM fact_region GROUP BY ALL))""",
    w10_share_of_parent="""
SELECT *, round(prediction / sum(prediction) OVER (PARTITION BY store_nbr) * 100, 4) AS share_percent
FROM (SELECT store_nbr, family, round(sum(sales), 2) AS prediction FROM fact_nation GROUP BY ALL)""",
)
