import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleswright.functions.dates import date_features
from saleswright.operators import enrich, windows
from saleswright.operators.clean import assert_no_nulls, select_features
from saleswright.plans.features import build_feature_matrix


def test_lags_stay_within_their_series(fact):
    rows = windows.add_lags(fact, lags=[1]).where("store_nbr = 1 AND family = 'DAIRY'").orderBy("date").collect()
    assert rows[0]["sales_lag_1"] is None
    assert [r["sales_lag_1"] for r in rows[1:]] == [r["sales"] for r in rows[:-1]]


def test_rolling_mean_uses_only_earlier_days(make_days):
    df = make_days(10, store_nbr=[1] * 10, family=["A"] * 10, sales=[100.0 * (i + 1) for i in range(10)])
    rows = windows.add_rolling(df, windows=[3]).orderBy("date").collect()
    assert [r["sales_rolling_mean_3"] for r in rows[:3]] == [None] * 3
    assert rows[4]["sales_rolling_mean_3"] == 300.0
    assert rows[4]["sales_rolling_std_3"] == 100.0


def test_rolling_is_null_while_the_window_holds_a_null(make_days):
    df = make_days(8, store_nbr=[1] * 8, family=["A"] * 8, sales=[1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
    rows = windows.add_rolling(df, windows=[2]).orderBy("date").collect()
    assert [r["sales_rolling_mean_2"] for r in rows] == [None, None, None, None, 3.5, 4.5, 5.5, 6.5]


def test_promotion_sum_sees_unfilled_values(make_days):
    df = make_days(9, store_nbr=[1] * 9, family=["A"] * 9, onpromotion=[1, None, 1, 1, 1, 1, 1, 1, 1])
    rows = windows.promo_features(df).orderBy("date").collect()
    assert rows[1]["onpromotion"] == 0
    assert [r["promo_rolling_7"] for r in rows] == [0] * 9
    assert "promo_rolling_7" not in windows.promo_features(df.drop("onpromotion")).columns


def test_date_features(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2017, 2, 15),), (dt.date(2020, 2, 29),)], "date date")
    rows = date_features(df).orderBy("date").collect()
    assert [r["is_mid_month"] for r in rows] == [0, 1, 0]
    assert [r["is_leap_year"] for r in rows] == [0, 0, 1]
    assert [r["dayofweek"] for r in rows] == [7, 3, 6]
    assert [r["week_of_month"] for r in rows] == [1, 3, 5]
    assert rows[2]["dayofyear"] == 60 and rows[2]["quarter"] == 1


def test_matrix_has_no_null_in_its_longest_lag(fact):
    matrix = build_feature_matrix(fact, 10)
    assert matrix.where(F.col("sales_lag_10").isNull()).count() == 0
    assert matrix.count() == 4 * 110
    assert matrix.where(F.col("unique_id").contains("_")).count() == 4 * 110


def test_no_feature_moves_when_a_later_day_changes(fact):
    day = dt.date(2017, 3, 20)
    changed = fact.withColumn("sales", F.when(F.col("date") == day, 1e6).otherwise(F.col("sales")))
    upto = F.col("date") <= day
    before = build_feature_matrix(fact, 14).where(upto).drop("sales")
    after = build_feature_matrix(changed, 14).where(upto).drop("sales")
    assert before.exceptAll(after).count() == 0
    assert build_feature_matrix(changed, 14).where(~upto).drop("sales").exceptAll(build_feature_matrix(fact, 14).drop("sales")).count() > 0


def test_year_blocks_give_the_same_windows(spark):
    """Sparse series: some years hold fewer rows than the windows reach back."""
    rows = spark.range(0, 9000, 1).select(
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("date"),
        (F.col("id") % 2 + 1).cast("int").alias("store_nbr"),
        F.lit("A").alias("family"),
        (F.col("id") * 7919 % 1000).cast("double").alias("sales"),
        (F.col("id") % 5).alias("onpromotion"),
    )
    sparse = rows.where((F.col("store_nbr") == 1) | (F.dayofyear("date") % 30 == 0))
    plain, blocks = build_feature_matrix(sparse, 60), build_feature_matrix(sparse, 60, year_blocks=True)
    rounded = [F.round(c, 6).alias(c) if "rolling" in c else F.col(c) for c in sorted(plain.columns)]
    assert plain.count() == blocks.count() > 0
    assert plain.select(rounded).exceptAll(blocks.select(rounded)).count() == 0


def test_oil_is_filled_forward(make_days, spark):
    fact = make_days(5, store_nbr=[1] * 5, family=["A"] * 5, sales=[1.0] * 5)
    oil = fact.where(F.dayofmonth("date").isin(1, 3, 5)).select(
        "date", F.element_at(F.array(F.lit(50.0), F.lit(None), F.lit(52.0), F.lit(None), F.lit(55.0)), F.dayofmonth("date")).alias("dcoilwtico")
    )
    rows = enrich.join_oil(fact, oil).orderBy("date").collect()
    assert [r["oil_price"] for r in rows] == [50.0, 50.0, 52.0, 52.0, 55.0]


def test_leading_oil_gap_takes_the_row_weighted_median(spark):
    fact = spark.createDataFrame(
        [(dt.date(2017, 1, 1), 1)] + [(dt.date(2017, 1, 2), i) for i in range(1)] + [(dt.date(2017, 1, 3), i) for i in range(5)],
        "date date, store_nbr int",
    )
    oil = spark.createDataFrame([(dt.date(2017, 1, 2), 10.0), (dt.date(2017, 1, 3), 30.0)], "date date, dcoilwtico double")
    assert enrich.join_oil(fact, oil).where("date = '2017-01-01'").first()["oil_price"] == 30.0


def test_holidays_and_stores(make_days, spark):
    fact = make_days(5, store_nbr=[1, 2, 3, 1, 2], family=["A"] * 5, sales=[1.0] * 5)
    holidays = spark.createDataFrame(
        [(dt.date(2017, 1, 1), "Holiday", "National"), (dt.date(2017, 1, 2), "Event", "National"), (dt.date(2017, 1, 2), "Holiday", "National"),
         (dt.date(2017, 1, 3), "Holiday", "Local")], "date date, type string, locale string")
    rows = enrich.join_holidays(fact, holidays).orderBy("date").collect()
    assert [r["is_holiday"] for r in rows] == [1, 1, 0, 0, 0]
    stores = spark.createDataFrame([(1, "Quito", "A"), (2, "Cuenca", "B"), (3, "Loja", "C")], "store_nbr int, city string, type string")
    assert [r["city"] for r in enrich.join_stores(fact, stores).orderBy("date").collect()] == ["Quito", "Cuenca", "Loja", "Quito", "Cuenca"]


def test_enrich_without_side_tables_changes_nothing(fact):
    assert enrich.enrich(fact, {}).exceptAll(fact).count() == 0


def test_null_guard_fails_the_job(make_days):
    df = make_days(3, sales=[1.0, None, 2.0])
    with pytest.raises(Exception, match="null value in column sales"):
        assert_no_nulls(df, ["sales"]).agg(F.sum("sales")).collect()
    assert assert_no_nulls(df.dropna(), ["sales"]).count() == 2


def test_missing_features_are_reported(fact):
    projected, missing = select_features(build_feature_matrix(fact, 28))
    assert "sales_lag_90" in missing and "oil_price" in missing
    assert "sales_lag_28" in projected.columns


def test_share_of_parent_and_trend(spark):
    df = spark.createDataFrame([("p", "a", 30.0), ("p", "b", 70.0), ("q", "c", 0.0)], "parent string, id string, prediction double")
    shares = {r["id"]: r["share_percent"] for r in windows.share_of_parent(df, ["parent"]).collect()}
    assert shares == {"a": 30.0, "b": 70.0, "c": None}
    trend = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 112.0), ("a", 3, 0.0), ("a", 4, 5.0)], "id string, period int, prediction double")
    rows = windows.with_trend(trend, ["id"], "period").orderBy("period").collect()
    assert [r["trend_percent"] and round(r["trend_percent"], 6) for r in rows] == [None, 12.0, -100.0, 0.0]


def test_daily_fact_merges_rows_of_a_day(fact):
    doubled = windows.daily_fact(fact.unionByName(fact))
    assert doubled.count() == fact.count()
    assert doubled.agg(F.sum("sales")).first()[0] == 2 * fact.agg(F.sum("sales")).first()[0]


@pytest.mark.parametrize("lengths", [(5,), (3, 8), (90, 7, 28, 14), (4, 5, 6, 40)])
def test_composed_windows_equal_sliding_ones(fact, lengths):
    from pyspark.sql.window import Window

    noisy = fact.withColumn("sales", F.when(F.dayofmonth("date") != 17, F.hash("date", "store_nbr", "family") % 1000 + 5e5))
    out = windows.add_rolling(noisy, windows=lengths)
    for n in lengths:
        frame = Window.partitionBy("store_nbr", "family").orderBy("date").rowsBetween(-n, -1)
        full = F.count("sales").over(frame) == n
        out = out.withColumns({f"m{n}": F.when(full, F.avg("sales").over(frame)), f"s{n}": F.when(full, F.stddev_samp("sales").over(frame))})
    for n in lengths:
        for ours, theirs in ((f"sales_rolling_mean_{n}", f"m{n}"), (f"sales_rolling_std_{n}", f"s{n}")):
            gap = F.abs(F.col(ours) - F.col(theirs)) > 1e-6
            assert out.where(gap | (F.col(ours).isNull() != F.col(theirs).isNull())).count() == 0
