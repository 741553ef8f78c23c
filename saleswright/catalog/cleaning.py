"""Guards, cleaning, projections and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.dates import date_features, forecast_grid, history_grid
from ..operators import clean, hierarchy
from ..plans.features import window_features
from ..sources import sample
from . import base
from .base import DATE_PARTS, r, rounded, sql_table


def c1_null_counts(spark, sf_dir):
    windowed = window_features(base.fact(spark, sf_dir), 28)
    return clean.null_counts(windowed, ["sales", "sales_lag_1", "sales_lag_28", "sales_rolling_mean_7", "sales_rolling_std_28"])


def c2_clip_negative(spark, sf_dir):
    shifted = base.fact(spark, sf_dir).select("date", "store_nbr", "family", r(F.col("sales") - 60000, 2).alias("sales"))
    return clean.clip_negative(shifted)


def c2_negative_count(spark, sf_dir):
    return clean.negative_count(base.fact(spark, sf_dir).select((F.col("sales") - 60000).alias("sales")))


def c3_profile(spark, sf_dir):
    return clean.profile(base.fact(spark, sf_dir))


def c4_national_holidays(spark, sf_dir):
    return clean.national_holidays(sample.holidays(spark, sf_dir))


def c5_fill_defaults(spark, sf_dir):
    df = base.fact(spark, sf_dir).withColumns(
        {"onpromotion": F.nullif("onpromotion", F.lit(0)), "is_holiday": F.when(F.dayofmonth("date") == 1, 1)}
    )
    return clean.fill_defaults(df, {"onpromotion": F.lit(0).cast("long"), "is_holiday": 0, "absent": 0})


def c6_warmup_counts(spark, sf_dir):
    return clean.warmup_counts(window_features(base.fact(spark, sf_dir), 90), 90)


def c7_available_features(spark, sf_dir):
    projected, _ = clean.select_features(base.staged_features(spark, sf_dir), keep=("unique_id", "date"))
    rolling = [c for c in projected.columns if "rolling_mean" in c or "rolling_std" in c]
    return rounded(projected, 4, *rolling)


def c8_series_format(spark, sf_dir):
    return clean.to_series(base.fact(spark, sf_dir))


def c12_data_gates(spark, sf_dir):
    from ..operators.gates import data_gates

    windowed = window_features(base.enriched(spark, sf_dir).drop("city"), 28)
    gates = data_gates(windowed, 0.05, 1000, ("date", "store_nbr", "family", "sales", "family_encoded"))
    return rounded(gates, 8, "value")


def c13_node_search(spark, sf_dir):
    nodes = hierarchy.tree_nodes(base.fact(spark, sf_dir, "nation"))
    return rounded(hierarchy.search_nodes(nodes, "uRn").select("id", "name", "level", "prediction"), 2, "prediction")


def d1_date_features(spark, sf_dir):
    return date_features(base.fact(spark, sf_dir).select("date", "store_nbr", "family"))


def d5_series_id(spark, sf_dir):
    uid = text.series_id(F.col("store_nbr"), F.concat(F.col("family"), F.lit("_X")))
    keyed = base.fact(spark, sf_dir).select("date", uid.alias("unique_id"))
    store, family = text.split_series_id(F.col("unique_id"))
    return keyed.withColumns({"store_nbr": store, "family": family})


def d6_forecast_grid(spark, sf_dir):
    df = base.fact(spark, sf_dir).select(
        "date", "store_nbr", "family", F.element_at(F.array(F.lit(15), F.lit(30), F.lit(60), F.lit(90)), F.month("date") % 4 + 1).alias("horizon")
    )
    return forecast_grid(df)


def d7_history_grid(spark, sf_dir):
    df = base.fact(spark, sf_dir).select("store_nbr", "family", F.col("date").alias("end_date"), F.when(F.dayofyear("date") % 97 == 0, 400).otherwise(F.dayofyear("date") % 60 - 20).alias("days"))
    return history_grid(df)


def d8_math_columns(spark, sf_dir):
    y, p = F.col("sales"), F.col("sales") - F.col("onpromotion") * 50000
    return base.fact(spark, sf_dir).select(
        "date", "store_nbr", "family", r(F.log1p(y), 6).alias("log_sales"), r(F.sqrt(y), 6).alias("root_sales"),
        r(F.abs(p), 2).alias("abs_net"), r(numbers.floor_zero(p), 2).alias("clipped"),
        r(numbers.squared_error(y, p), 0).alias("squared"),
    )


def d9_node_ids(spark, sf_dir):
    store, family = F.col("store_nbr"), F.replace(F.col("family"), F.lit("U"), F.lit("U "))
    return base.fact(spark, sf_dir).select(
        text.store_node_id(store).alias("store_id"), text.family_node_id(store, family).alias("family_id")
    ).distinct()


def d10_request_key(spark, sf_dir):
    return base.fact(spark, sf_dir).select(
        text.request_key(F.col("store_nbr"), F.col("family"), F.col("date"), F.lit(30)).alias("request_key"), "sales"
    )


def d11_money_formats(spark, sf_dir):
    s = F.col("sales")
    net = r(s * 7 - 200000.003, 3)
    return base.fact(spark, sf_dir).select(
        "date", "store_nbr", "family", text.format_money(s).alias("compact"), text.format_money(net, 1, signed=True).alias("signed"),
        text.format_dollars(s).alias("dollars"), text.format_decimal(s).alias("decimals"),
    )


def d12_export_names(spark, sf_dir):
    family = F.replace(F.col("family"), F.lit("I"), F.lit("  I"))
    return base.fact(spark, sf_dir).select(
        text.export_name(F.col("store_nbr"), family, F.col("date"), F.lit(30)).alias("name")
    )


def d13_trend_class(spark, sf_dir):
    change = numbers.pct_change(F.col("sales"), F.col("sales_lag_7"))
    return base.staged_features(spark, sf_dir).select("unique_id", "date", numbers.trend_class(change / 20).alias("trend"))


def d14_percent_change(spark, sf_dir):
    before = F.when(F.dayofmonth("date") == 3, 0.0).otherwise(F.col("sales_lag_7"))
    return base.staged_features(spark, sf_dir).select("unique_id", "date", r(numbers.pct_change(F.col("sales"), before), 4).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        c1_null_counts, c2_clip_negative, c2_negative_count, c3_profile, c4_national_holidays, c5_fill_defaults,
        c6_warmup_counts, c7_available_features, c8_series_format, c12_data_gates, c13_node_search, d1_date_features,
        d5_series_id, d6_forecast_grid, d7_history_grid, d8_math_columns, d9_node_ids, d10_request_key, d11_money_formats,
        d12_export_names, d13_trend_class, d14_percent_change,
    )
}

_ROLL = ", ".join(f"round(sales_rolling_{k}_{n}, 4) AS sales_rolling_{k}_{n}" for k in ("mean", "std") for n in (7, 14, 28))
_COUNTS = "count(*) FILTER (WHERE sales_lag_{n} IS NULL)"
_LAG_NULLS = """(SELECT *, lag(sales, 1) OVER s AS sales_lag_1, lag(sales, 28) OVER s AS sales_lag_28,
   row_number() OVER s AS rn FROM fact_region WINDOW s AS (PARTITION BY store_nbr, family ORDER BY date))"""
_CHANGE = "CASE WHEN {p} = 0 THEN 0 ELSE (sales - {p}) / {p} * 100 END"

SQL = sql_table(
    c1_null_counts=f"""
SELECT count(*) FILTER (WHERE sales IS NULL) AS sales, count(*) FILTER (WHERE sales_lag_1 IS NULL) AS sales_lag_1,
       count(*) FILTER (WHERE sales_lag_28 IS NULL) AS sales_lag_28, count(*) FILTER (WHERE rn <= 7) AS sales_rolling_mean_7,
       count(*) FILTER (WHERE rn <= 28) AS sales_rolling_std_28 FROM {_LAG_NULLS}""",
    c2_clip_negative="SELECT date, store_nbr, family, greatest(round(sales - 60000, 2), 0) AS sales FROM fact_region",
    c2_negative_count="SELECT count(*) FILTER (WHERE sales < 60000) AS n_negative, count(*) AS n_rows FROM fact_region",
    c3_profile="SELECT count(*) AS n_rows, 5 AS n_columns, min(date) AS min_date, max(date) AS max_date FROM fact_region",
    c4_national_holidays="SELECT DISTINCT date, 1 AS is_holiday FROM holiday_list WHERE locale = 'National'",
    c5_fill_defaults="SELECT *, CAST(day(date) = 1 AS INTEGER) AS is_holiday FROM fact_region",
    c6_warmup_counts="""
SELECT count(l) AS n_kept, count(*) FILTER (WHERE l IS NULL) AS n_dropped
FROM (SELECT lag(sales, 90) OVER (PARTITION BY store_nbr, family ORDER BY date) AS l FROM fact_region)""",
    c7_available_features=f"""
SELECT unique_id, date, year, month, day, dayofweek, dayofyear, is_mid_month, is_leap_year, oil_price, is_holiday, onpromotion,
       promo_rolling_7, cluster, sales_lag_1, sales_lag_7, sales_lag_14, sales_lag_28, {_ROLL}, family, type FROM features_28""",
    c8_series_format="SELECT * FROM series_region",
    c12_data_gates="""
SELECT unnest(['data_null_ratio', 'data_row_count', 'required_columns']) AS gate, unnest([round(nulls / (n * 20), 8), n, 1]) AS value,
       unnest([0.05, 1000.0, 0.0]) AS threshold, unnest([nulls / (n * 20) < 0.05, n >= 1000, false]) AS passed,
       unnest([NULL, NULL, 'family_encoded']) AS note
FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
        CAST(sum(least(rn - 1, 0) + (rn <= 1)::INT + 3 * (rn <= 7)::INT + 3 * (rn <= 14)::INT + 3 * (rn <= 28)::INT) AS DOUBLE) AS nulls
      FROM (SELECT row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) AS rn FROM fact_region))""",
    c13_node_search="""
SELECT store_nbr || '_' || family AS id, family AS name, 'family' AS level, round(coalesce(sum(sales), 0), 2) AS prediction
FROM (SELECT DISTINCT store_nbr FROM fact_nation) CROSS JOIN (SELECT DISTINCT family FROM fact_nation)
LEFT JOIN fact_nation USING (store_nbr, family) WHERE family LIKE '%URN%' GROUP BY store_nbr, family""",
    d1_date_features=f"SELECT date, store_nbr, family, {DATE_PARTS} FROM fact_region",
    d5_series_id="SELECT date, store_nbr || '_' || family || '_X' AS unique_id, store_nbr, family || '_X' AS family FROM fact_region",
    d6_forecast_grid="""
SELECT date, store_nbr, family, horizon, CAST(unnest(generate_series(date, date + CAST(ceil(horizon / 7) - 1 AS INTEGER) * 7, INTERVAL 7 DAY)) AS DATE) AS ds
FROM (SELECT *, [15, 30, 60, 90][month(date) % 4 + 1] AS horizon FROM fact_region)""",
    d7_history_grid="""
SELECT store_nbr, family, date AS end_date, days,
       CAST(unnest(generate_series(date - (CASE WHEN days > 0 THEN least(days, 365) ELSE 28 END), date - 1, INTERVAL 7 DAY)) AS DATE) AS date
FROM (SELECT *, CAST(CASE WHEN dayofyear(date) % 97 = 0 THEN 400 ELSE dayofyear(date) % 60 - 20 END AS INTEGER) AS days FROM fact_region)""",
    d8_math_columns="""
SELECT date, store_nbr, family, round(ln(1 + sales), 6) AS log_sales, round(sqrt(sales), 6) AS root_sales,
       round(abs(sales - onpromotion * 50000), 2) AS abs_net, round(greatest(sales - onpromotion * 50000, 0), 2) AS clipped,
       round(pow(sales - (sales - onpromotion * 50000), 2), 0) AS squared FROM fact_region""",
    d9_node_ids="SELECT DISTINCT 'store_' || store_nbr AS store_id, store_nbr || '_' || replace(family, 'U', 'U_') AS family_id FROM fact_region",
    d10_request_key="SELECT 'pred:v1:' || store_nbr || ':' || family || ':' || strftime(date, '%Y-%m-%d') || ':30' AS request_key, sales FROM fact_region",
    d11_money_formats="""
SELECT date, store_nbr, family,
       CASE WHEN sales >= 1e6 THEN printf('$%.2fM', sales / 1e6) WHEN sales >= 1000 THEN printf('$%.0fK', sales / 1000) ELSE printf('$%.0f', sales) END AS compact,
       CASE WHEN abs(net) >= 1e6 THEN printf('$%.2fM', net / 1e6) WHEN abs(net) >= 1000 THEN printf('$%.1fK', net / 1000) ELSE printf('$%.0f', net) END AS signed,
       '$' || format('{:,.0f}', sales) AS dollars, format('{:,.2f}', sales) AS decimals
FROM (SELECT *, round(sales * 7 - 200000.003, 3) AS net FROM fact_region)""",
    d12_export_names="""
SELECT 'forecast_store' || store_nbr || '_' || regexp_replace(lower(replace(family, 'I', '  I')), '\\s+', '-', 'g') || '_' || strftime(date, '%Y-%m-%d') || '_30d.csv' AS name
FROM fact_region""",
    d13_trend_class=f"""
SELECT unique_id, date, CASE WHEN c / 20 > 1 THEN 'up' WHEN c / 20 < -1 THEN 'down' ELSE 'stable' END AS trend
FROM (SELECT *, {_CHANGE.format(p="sales_lag_7")} AS c FROM features_28)""",
    d14_percent_change=f"""
SELECT unique_id, date, round({_CHANGE.format(p="b")}, 4) AS change
FROM (SELECT *, CASE WHEN day(date) = 3 THEN 0 ELSE sales_lag_7 END AS b FROM features_28)""",
)
