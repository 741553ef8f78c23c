"""Lags, rolling windows, the feature matrix and seasonal forecasts by calendar day, on series with gaps."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import calendar, forecast
from ..operators.enrich import enrich
from ..plans.features import build_feature_matrix
from ..sources import sample
from . import base
from .base import define, rounded, sql_table

OFF_BORDER = 0.000001
ALL_LAGS, ALL_WINDOWS = (1, 7, 14, 28, 90), (7, 14, 28, 90)


def _rounded_rolling(df):
    return rounded(df, 4, *[c for c in df.columns if "rolling_mean" in c or "rolling_std" in c])


def w1_calendar_lags(spark, sf_dir):
    return base.fact(spark, sf_dir).withColumns(calendar.calendar_lags("sales", ALL_LAGS, absent="skip"))


def w1_calendar_lags_zero(spark, sf_dir):
    return base.fact(spark, sf_dir).withColumns(calendar.calendar_lags("sales", ALL_LAGS))


def w2_calendar_rolling(spark, sf_dir):
    return _rounded_rolling(base.fact(spark, sf_dir).withColumns(calendar.calendar_rolling("sales", ALL_WINDOWS)))


def w2_calendar_rolling_present(spark, sf_dir):
    rolled = base.fact(spark, sf_dir).withColumns(calendar.calendar_rolling("sales", ALL_WINDOWS, absent="skip"))
    # Means of 8, 16, ... amounts of cents lie on rounding borders; a little more takes them off.
    return _rounded_rolling(rolled.withColumns({c: F.col(c) + OFF_BORDER for c in rolled.columns if "rolling" in c}))


def w4_calendar_promotions(spark, sf_dir):
    raw = base.fact(spark, sf_dir).withColumn("onpromotion", F.when(F.dayofmonth("date") != 9, F.col("onpromotion")))
    return raw.withColumns(calendar.calendar_promotions())


def w6_calendar_matrix(spark, sf_dir):
    return _rounded_rolling(build_feature_matrix(base.enriched(spark, sf_dir), 90, calendar="zero"))


def w6_calendar_matrix_year_blocks(spark, sf_dir):
    return _rounded_rolling(build_feature_matrix(base.enriched(spark, sf_dir), 90, year_blocks=True, calendar="zero"))


def w6_matrix_of_merged_days(spark, sf_dir):
    """The fact by nation, named by region: several rows a day and series, merged by the plan."""
    nations = sample.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("_nation"), (F.col("n_regionkey") + 1).cast("int").alias("_region"))
    many = base.fact(spark, sf_dir, "nation").join(nations, F.col("store_nbr") == F.col("_nation")).select("date", F.col("_region").alias("store_nbr"), "family", "sales", "onpromotion")
    side = {name: df for name, df in sample.external(spark, sf_dir).items() if name != "oil"}  # its median weighs dates by rows
    matrix = build_feature_matrix(enrich(many, side), 90, merge_days=True)
    return rounded(_rounded_rolling(matrix), 2, "sales", *[f"sales_lag_{k}" for k in ALL_LAGS])


def f4_calendar_naive(spark, sf_dir):
    return forecast.seasonal_naive(base.series(spark, sf_dir), 14, absent="zero")


def f4_calendar_naive_present(spark, sf_dir):
    return forecast.seasonal_naive(base.series(spark, sf_dir), 14, absent="skip")


QUERIES = {
    f.__name__: f
    for f in (
        w1_calendar_lags, w1_calendar_lags_zero, w2_calendar_rolling, w2_calendar_rolling_present, w4_calendar_promotions,
        w6_calendar_matrix, w6_calendar_matrix_year_blocks, w6_matrix_of_merged_days, f4_calendar_naive, f4_calendar_naive_present,
    )
}

# The SQL writes every day of every series and counts rows of that calendar.
define("whole_calendar", """
SELECT s.store_nbr, s.family, s.date, f.sales, f.onpromotion, coalesce(f.sales, 0) AS filled, f.date IS NOT NULL AS present
FROM (SELECT store_nbr, family, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM fact_region GROUP BY store_nbr, family) s
LEFT JOIN fact_region f ON f.store_nbr = s.store_nbr AND f.family = s.family AND f.date = s.date""")

_SERIES = "PARTITION BY store_nbr, family ORDER BY date"


def _lags(column: str) -> str:
    return ", ".join(f"lag({column}, {k}) OVER ({_SERIES}) AS sales_lag_{k}" for k in ALL_LAGS)


def _rolling(column: str) -> str:
    parts = []
    for n in ALL_WINDOWS:
        frame = f"OVER ({_SERIES} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts += [f"CASE WHEN count(*) {frame} = {n} THEN {fn}({column}) {frame} END AS sales_rolling_{name}_{n}" for fn, name in (("avg", "mean"), ("stddev_samp", "std"))]
    return ", ".join(parts)


def _promo(raw: str) -> str:
    frame = f"OVER ({_SERIES} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    return f"CAST(CASE WHEN count(*) {frame} = 7 THEN coalesce(sum({raw}) {frame}, 0) ELSE 0 END AS BIGINT) AS promo_rolling_7"


def _round(columns: list[str], more: str = "") -> str:
    return ", ".join(f"round({c}{more}, 4) AS {c}" for c in columns)


_ROLLED = [f"sales_rolling_{k}_{n}" for k in ("mean", "std") for n in ALL_WINDOWS]
_KEPT = "store_nbr, family, date, sales, onpromotion"

_MATRIX = f"""
SELECT e.* REPLACE (coalesce(e.onpromotion, 0) AS onpromotion), w.* EXCLUDE (store_nbr, family, date, present) REPLACE ({_round(_ROLLED)}),
       e.store_nbr || '_' || e.family AS unique_id, {re.sub(r"\bdate\b", "e.date", base.DATE_PARTS)}
FROM enriched e JOIN (SELECT store_nbr, family, date, present, {_lags("filled")}, {_rolling("filled")}, {_promo("onpromotion")} FROM whole_calendar) w
  ON w.store_nbr = e.store_nbr AND w.family = e.family AND w.date = e.date
WHERE sales_lag_90 IS NOT NULL"""

def _naive(value: str) -> str:
    return f"""
SELECT e.unique_id, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, {value} AS y_hat
FROM (SELECT unique_id, max(ds) AS last_ds, min(ds) AS first_ds FROM series_region GROUP BY unique_id) e CROSS JOIN range(1, 15) s(step)
LEFT JOIN series_region d ON d.unique_id = e.unique_id AND d.ds = e.last_ds - 6 + CAST((step - 1) % 7 AS INTEGER)
WHERE last_ds - first_ds >= 6"""


SQL = sql_table(
    w1_calendar_lags=f"SELECT * EXCLUDE (present) FROM (SELECT {_KEPT}, present, {_lags('sales')} FROM whole_calendar) WHERE present",
    w1_calendar_lags_zero=f"SELECT * EXCLUDE (present) FROM (SELECT {_KEPT}, present, {_lags('filled')} FROM whole_calendar) WHERE present",
    w2_calendar_rolling=f"SELECT * EXCLUDE (present) REPLACE ({_round(_ROLLED)}) FROM (SELECT {_KEPT}, present, {_rolling('filled')} FROM whole_calendar) WHERE present",
    w2_calendar_rolling_present=f"SELECT * EXCLUDE (present) REPLACE ({_round(_ROLLED, f' + {OFF_BORDER:f}')}) FROM (SELECT {_KEPT}, present, {_rolling('sales')} FROM whole_calendar) WHERE present",
    w4_calendar_promotions=f"""
SELECT * EXCLUDE (present) REPLACE (coalesce(onpromotion, 0) AS onpromotion)
FROM (SELECT * EXCLUDE (filled), {_promo("onpromotion")} FROM (SELECT * REPLACE (CASE WHEN day(date) <> 9 THEN onpromotion END AS onpromotion) FROM whole_calendar)) WHERE present""",
    w6_calendar_matrix=_MATRIX,
    w6_calendar_matrix_year_blocks=_MATRIX,
    w6_matrix_of_merged_days=f"SELECT * EXCLUDE (oil_price) REPLACE ({_round(_ROLLED)}) FROM features_90",
    f4_calendar_naive=_naive("coalesce(d.y, 0)"),
    f4_calendar_naive_present=_naive("d.y"),
)
