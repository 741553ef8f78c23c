"""Shared frames of the registered queries, and the same frames as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import series_id
from ..operators.enrich import enrich
from ..plans.features import build_feature_matrix
from ..sources import sample
from ..sources.sample import HOLIDAY_DAYS
from ..sources.stages import staged

LINEAR_FEATURES = (
    "dayofweek", "month", "oil_price", "is_holiday", "onpromotion", "promo_rolling_7", "cluster",
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_28",
    "sales_rolling_mean_7", "sales_rolling_mean_28", "sales_rolling_std_7",
)
HORIZON = 28
"""Longest lag of the registered feature queries: the sample series are short at the smallest scale."""


def fact(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    return staged(spark, (f"fact_{grain}", sf_dir), lambda: sample.sales_fact(spark, sf_dir, grain))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(fact(spark, sf_dir), sample.external(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, horizon: int = HORIZON) -> DataFrame:
    return build_feature_matrix(enriched(spark, sf_dir), horizon)


def staged_features(spark: SparkSession, sf_dir: str, horizon: int = HORIZON) -> DataFrame:
    """The feature matrix as a written stage, as the steps after it read it."""
    return staged(spark, (f"features_{horizon}", sf_dir), lambda: features(spark, sf_dir, horizon))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).select(
        series_id(F.col("store_nbr"), F.col("family")).alias("unique_id"), F.col("date").alias("ds"), F.col("sales").alias("y")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.request_events(spark, sf_dir)


def naive(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps without zone, as the data has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols or ("window_start", "window_end")})


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: r(F.col(c), places) for c in cols})


def r(x: Column, places: int) -> Column:
    # Adding 0.0 turns a negative zero into a plain one.
    return F.round(x, places) + F.lit(0.0)


# --- the same frames in SQL ---------------------------------------------------------------------

CTES: dict[str, str] = {}


def define(name: str, text: str) -> None:
    CTES[name] = text.strip()


def with_ctes(text: str) -> str:
    """Prefix a query with the definitions it refers to, directly or through others."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in CTES:
            if name not in order and body != CTES[name] and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", body):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(text)
    if not order:
        return text.strip()
    heads = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in order)
    return f"WITH {heads}\n{text.strip()}"


def sql_table(**texts: str) -> dict[str, str]:
    return {name: with_ctes(text) for name, text in texts.items()}


def _fact_sql(key: str, joins: str) -> str:
    return f"""
SELECT CAST(l_shipdate AS DATE) AS date, CAST({key} + 1 AS INTEGER) AS store_nbr, c_mktsegment AS family,
       round(sum(l_extendedprice), 2) AS sales,
       CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS onpromotion
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {joins}
GROUP BY ALL"""


define("fact_region", _fact_sql("n_regionkey", "JOIN nation ON c_nationkey = n_nationkey"))
define("fact_nation", _fact_sql("c_nationkey", ""))
define("series_region", "SELECT store_nbr || '_' || family AS unique_id, date AS ds, sales AS y FROM fact_region")
define("oil_quotes", """
SELECT CAST(o_orderdate AS DATE) AS date,
       CASE WHEN day(o_orderdate) % 11 <> 0
            THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) / 100 END AS dcoilwtico
FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY o_orderdate""")
define("holiday_list", f"""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'Holiday' AS type,
       CASE WHEN year(o_orderdate) % 2 = 0 THEN 'National' ELSE 'Local' END AS locale
FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ({", ".join(f"'{d}'" for d in HOLIDAY_DAYS)})""")
define("store_list", """
SELECT CAST(r_regionkey + 1 AS INTEGER) AS store_nbr, r_name AS city, chr(CAST(65 + r_regionkey % 5 AS INTEGER)) AS type,
       CAST(r_regionkey % 3 AS INTEGER) AS cluster FROM region""")
define("oil_filled", """
SELECT date, last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS oil_price FROM oil_quotes""")
define("fact_oil", """
SELECT f.*, coalesce(o.oil_price, median(o.oil_price) OVER ()) AS oil_price
FROM fact_region f LEFT JOIN (
  SELECT d.date, last_value(q.oil_price IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS oil_price
  FROM (SELECT DISTINCT date FROM fact_region) d LEFT JOIN oil_filled q USING (date)) o USING (date)""")
define("enriched", """
SELECT f.*, s.city, s.type, s.cluster, CAST(coalesce(h.is_holiday, 0) AS INTEGER) AS is_holiday
FROM fact_oil f LEFT JOIN store_list s USING (store_nbr)
LEFT JOIN (SELECT DISTINCT date, 1 AS is_holiday FROM holiday_list WHERE locale = 'National') h USING (date)""")

DATE_PARTS = """
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
       CAST(isodow(date) AS INTEGER) AS dayofweek, CAST(dayofyear(date) AS INTEGER) AS dayofyear,
       CAST(day(date) = 15 AS INTEGER) AS is_mid_month,
       CAST(day(last_day(make_date(year(date), 2, 1))) = 29 AS INTEGER) AS is_leap_year,
       CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS week_of_month, CAST((month(date) - 1) // 3 + 1 AS INTEGER) AS quarter"""


def lags_sql(lags: tuple[int, ...]) -> str:
    return ", ".join(f"lag(sales, {k}) OVER series AS sales_lag_{k}" for k in lags)


def rolling_sql(windows: tuple[int, ...]) -> str:
    parts = []
    for n in windows:
        frame = f"OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for fn, name in (("avg", "mean"), ("stddev_samp", "std")):
            parts.append(f"CASE WHEN count(sales) {frame} = {n} THEN {fn}(sales) {frame} END AS sales_rolling_{name}_{n}")
    return ", ".join(parts)


PROMO_SQL = """CAST(coalesce(CASE WHEN count(onpromotion) OVER promo = 7 THEN sum(onpromotion) OVER promo END, 0) AS BIGINT) AS promo_rolling_7"""
NAMED_WINDOWS = """WINDOW series AS (PARTITION BY store_nbr, family ORDER BY date),
       promo AS (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


def feature_sql(horizon: int) -> str:
    lags = tuple(dict.fromkeys((1, 7, 14, 28, horizon)))
    windows = tuple(dict.fromkeys((7, 14, 28, horizon)))
    return f"""
SELECT * FROM (
  SELECT *, {lags_sql(lags)}, {rolling_sql(windows)}, {PROMO_SQL},
       store_nbr || '_' || family AS unique_id, {DATE_PARTS}
  FROM enriched {NAMED_WINDOWS}
) WHERE sales_lag_{horizon} IS NOT NULL"""


define("features_28", feature_sql(28))
define("features_90", feature_sql(90))

define("events_shaped", """
SELECT event_id, user_id, ts, event_type AS endpoint, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 1000 AS seconds,
       CASE WHEN event_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS cache,
       CASE WHEN event_id % 7 = 0 THEN 'zero_fallback' WHEN event_id % 2 = 0 THEN 'aggregated' ELSE 'exact' END AS lookup
FROM events""")

# The model behind the SQL-checked scoring and explanation queries: averaged single-feature lines.
_N = len(LINEAR_FEATURES)
define("model_params", "SELECT avg(sales) AS base, " + ", ".join(
    f"coalesce(regr_slope(sales, {f}), 0) / {_N} AS b_{f}, avg({f}) AS m_{f}" for f in LINEAR_FEATURES
) + " FROM features_28")


def predict_sql(alias: str = "f", params: str = "p", replaced: dict[str, str] | None = None) -> str:
    """base + Σ β·(x − mean) in SQL; ``replaced`` swaps in other expressions for single features."""
    replaced = replaced or {}
    terms = [f"{params}.b_{f} * ({replaced.get(f, f'{alias}.{f}')} - {params}.m_{f})" for f in LINEAR_FEATURES]
    return f"({params}.base + " + " + ".join(terms) + ")"
