import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from saleswright.operators import calendar, forecast
from saleswright.plans.features import build_feature_matrix

START = dt.date(2024, 1, 1)
#: Days since the start that have a row, and their sales; the rest has none.
ROWS = {0: 3.0, 1: 5.0, 2: 8.0, 5: 1.0, 6: 13.0, 7: 2.0, 13: 7.0, 20: 4.0}


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(START + dt.timedelta(days=i), 1, "A", v, 2) for i, v in ROWS.items()], "date date, store_nbr int, family string, sales double, onpromotion long")


def expected(day, n, absent):
    if day < n:
        return None, None
    values = [ROWS.get(d, 0.0 if absent == "zero" else None) for d in range(day - n, day)]
    values = [v for v in values if v is not None]
    return (statistics.fmean(values) if values else None), (statistics.stdev(values) if len(values) > 1 else None)


@pytest.mark.parametrize("absent", ["zero", "skip"])
def test_windows_and_lags_go_by_day(gaps, absent):
    found = gaps.withColumns(calendar.calendar_lags("sales", (1, 7), absent=absent) | calendar.calendar_rolling("sales", (3, 7), absent=absent))
    rows = {(r["date"] - START).days: r for r in found.collect()}
    for day, row in rows.items():
        for k in (1, 7):
            known = ROWS.get(day - k, 0.0 if absent == "zero" and day >= k else None)
            assert row[f"sales_lag_{k}"] == known
        for n in (3, 7):
            mean, std = expected(day, n, absent)
            assert row[f"sales_rolling_mean_{n}"] == (pytest.approx(mean) if mean is not None else None)
            assert row[f"sales_rolling_std_{n}"] == (pytest.approx(std) if std is not None else None)


def test_promotions_by_day(gaps):
    rows = {(r["date"] - START).days: r["promo_rolling_7"] for r in gaps.withColumns(calendar.calendar_promotions()).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 5: 0, 6: 0, 7: 10, 13: 4, 20: 2}


def test_one_shuffle_for_all_windows(gaps):
    columns = calendar.calendar_lags("sales", (1, 7)) | calendar.calendar_rolling("sales", (7, 28)) | calendar.calendar_promotions()
    plan = gaps.withColumns(columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_another_word_for_absent_days_is_refused():
    with pytest.raises(ValueError):
        calendar.calendar_lags("sales", (1,), absent="mean")


def test_year_blocks_know_where_a_series_began(spark):
    days = [d for d in range(0, 900) if d % 11 not in (3, 4)]
    rows = [(START + dt.timedelta(days=d), s, "A", float(d % 17 + s), d % 3) for d in days for s in (1, 2)]
    fact = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion long")
    whole = build_feature_matrix(fact, 90, calendar="zero")
    blocks = build_feature_matrix(fact, 90, year_blocks=True, calendar="zero")
    rolled = [c for c in whole.columns if "rolling" in c]
    a, b = ({(r["date"], r["store_nbr"]): r for r in df.collect()} for df in (whole, blocks))
    assert set(a) == set(b) and len(a) > 1000
    assert all(a[k][c] == pytest.approx(b[k][c]) for k in a for c in rolled)


def test_days_with_many_rows_are_merged(spark):
    days = range(0, 120)
    many = [(START + dt.timedelta(days=d), 1, "A", float(d + i), 1, "x") for d in days for i in range(3)]
    one = [(START + dt.timedelta(days=d), 1, "A", float(3 * d + 3), 3, "x") for d in days]
    schema = "date date, store_nbr int, family string, sales double, onpromotion long, city string"
    a = build_feature_matrix(spark.createDataFrame(many, schema), 28, merge_days=True)
    b = build_feature_matrix(spark.createDataFrame(one, schema), 28)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count() == 92


@pytest.mark.parametrize("absent,season", [("zero", [7.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0]), ("skip", [7.0, None, None, None, None, None, None, 4.0])])
def test_season_as_it_stands_in_the_calendar(gaps, absent, season):
    series = gaps.select(F.lit("1_A").alias("unique_id"), F.col("date").alias("ds"), F.col("sales").alias("y"))
    found = forecast.seasonal_naive(series, 8, 8, absent=absent).orderBy("ds").collect()
    assert [r["y_hat"] for r in found] == season
    assert found[0]["ds"] == START + dt.timedelta(days=21)
    assert forecast.seasonal_naive(series, 8, 30, absent=absent).count() == 0
