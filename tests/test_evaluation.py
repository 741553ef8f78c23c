import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleswright.operators import evaluate, forecast, gates, intervals, split
from saleswright.operators.facts import exact_quantiles


@pytest.fixture(scope="module")
def pairs(spark):
    return lambda rows: spark.createDataFrame([(float(a), float(b)) for a, b in rows], "y double, y_hat double")


def test_known_metrics(pairs):
    assert evaluate.metrics(pairs([(100, 110), (200, 210), (300, 310)])).first()["rmse"] == pytest.approx(10.0)
    assert evaluate.metrics(pairs([(100, 90), (200, 210), (300, 300)])).first()["mae"] == pytest.approx(20 / 3)
    clipped = evaluate.metrics(pairs([(0, -5), (10, 10)])).first()
    assert clipped["rmsle"] == pytest.approx(0.0) and clipped["n_samples"] == 2
    zero = evaluate.metrics(pairs([(0, 1)])).first()
    assert zero["mape"] == pytest.approx(1.0)


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "tiny", "single"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(0, 100, 5000),
        "heavy": rng.standard_cauchy(5000) * 1e4,
        "ties": np.where(rng.random(5000) < 0.4, 3.0, np.round(rng.normal(3, 1, 5000), 1)),
        "tiny": rng.normal(0, 1e-7, 3000),
        "single": np.array([4.5]),
    }[kind]
    df = spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(values)], "k string, v double")
    probs = {"a": 0.025, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.975, "lo": 0.0, "hi": 1.0}
    got = exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)
    for row in exact_quantiles(df, "v", {"m": 0.3}, ["k"]).collect():
        mine = [v for i, v in enumerate(values) if ("g" if i % 3 else None) == row["k"]]
        assert row["m"] == pytest.approx(np.quantile(mine, 0.3), rel=1e-12, abs=1e-15)


def test_interval_offsets_and_bands(spark, pairs):
    rng = np.random.default_rng(3)
    y, p = rng.normal(100, 20, 400), rng.normal(100, 5, 400)
    offsets = intervals.interval_offsets(pairs(zip(y, p)))
    row = offsets.first()
    for name, q in (("lower_80_offset", 10), ("upper_80_offset", 90), ("lower_95_offset", 2.5), ("upper_95_offset", 97.5)):
        assert row[name] == pytest.approx(np.percentile(y - p, q))
    assert row["std"] == pytest.approx(np.std(y - p)) and row["n_samples"] == 400
    banded = intervals.apply_intervals(spark.createDataFrame([(5.0,), (500.0,)], "prediction double"), offsets).collect()
    for r in banded:
        assert 0 <= r["lower_95"] <= r["lower_80"] <= r["upper_80"] <= r["upper_95"]
    none = intervals.apply_intervals(spark.createDataFrame([(5.0,)], "prediction double"), offsets.where("false")).first()
    assert none["lower_80"] is None
    filled = intervals.fallback_band(intervals.apply_intervals(spark.createDataFrame([(100.0,)], "prediction double"), offsets.where("false"))).first()
    assert (filled["lower_80"], filled["upper_80"], filled["lower_95"], filled["upper_95"]) == pytest.approx((90, 110, 85, 115))


def year_2017(spark):
    return spark.range(365).select(F.date_add(F.lit("2017-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("value"))


@pytest.mark.parametrize("train,gap", [(180, 0), (150, 30)])
def test_folds_do_not_leak(spark, train, gap):
    rows = split.walk_forward(year_2017(spark), train_days=train, valid_days=30, gap_days=gap)
    ends = {(r["fold"], r["role"]): r for r in rows.groupBy("fold", "role").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert {f for f, _ in ends} == {1, 2, 3}
    for fold in (1, 2, 3):
        assert (ends[fold, "valid"]["lo"] - ends[fold, "train"]["hi"]).days > gap
    assert ends[1, "valid"]["hi"] == dt.date(2017, 12, 31)
    assert (ends[1, "valid"]["hi"] - ends[1, "valid"]["lo"]).days == 30


def test_folds_without_enough_history_are_skipped(spark):
    assert split.walk_forward(year_2017(spark), train_days=365, valid_days=90).count() == 0
    gappy = year_2017(spark).where("date < '2017-06-01' OR date > '2017-11-15'")
    kept = split.folds(gappy, train_days=60, valid_days=30, n_splits=6)
    assert 0 < kept.count() < 6
    for r in kept.collect():
        inside = gappy.where((F.col("date") >= F.lit(r["valid_start"])) & (F.col("date") <= F.lit(r["valid_end"]))).count()
        assert inside > 0


def test_time_split_covers_all_rows(spark):
    train, valid = split.time_split(year_2017(spark), 90)
    assert train.count() + valid.count() == 365 and valid.count() == 91


def series(spark, values, uid="a"):
    return spark.createDataFrame(
        [(uid, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "unique_id string, ds date, y double"
    )


def test_seasonal_naive_repeats_the_last_week(spark):
    rows = forecast.seasonal_naive(series(spark, range(20)), 10).orderBy("step").collect()
    assert [r["y_hat"] for r in rows] == [13, 14, 15, 16, 17, 18, 19, 13, 14, 15]
    assert rows[0]["ds"] == dt.date(2020, 1, 21)
    assert forecast.seasonal_naive(series(spark, range(5)), 3).count() == 0


def smooth_by_hand(y, alpha):
    level, sse = y[0], 0.0
    for v in y[1:]:
        sse += (v - level) ** 2
        level += alpha * (v - level)
    return level, sse


def test_smoothing_picks_the_best_alpha(spark):
    y = np.random.default_rng(5).normal(50, 10, 80).cumsum()
    row = forecast.smooth(series(spark, y)).first()
    fits = {a: smooth_by_hand(y, a) for a in forecast.ALPHAS}
    best = min(fits, key=lambda a: fits[a][1])
    assert row["alpha"] == best
    assert (row["level"], row["sse"]) == pytest.approx(fits[best])


def test_seasonal_smoothing_recovers_a_weekly_pattern(spark):
    pattern = [10, 20, 30, 40, 50, 60, 0]
    rows = forecast.ets(series(spark, pattern * 8), 9, m=7).orderBy("step").collect()
    assert [r["y_hat"] for r in rows] == pytest.approx([10, 20, 30, 40, 50, 60, 0, 10, 20])


def test_forecast_bands_widen_with_the_level(spark):
    y = np.random.default_rng(5).normal(50, 10, 80)
    for r in forecast.forecast_all(series(spark, y), 14).groupBy("model", "ds").pivot("level", [80, 95]).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi")).collect():
        assert r["95_lo"] < r["80_lo"] < r["80_hi"] < r["95_hi"]


def test_rolling_origin_cutoffs(spark):
    rows = forecast.rolling_origin(series(spark, range(100)), h=7, windows=3, step=10)
    ends = {(r["fold"], r["role"]): (r["lo"], r["hi"]) for r in rows.groupBy("fold", "role").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    assert ends[3, "valid"] == (93, 99) and ends[3, "train"] == (0, 92) and ends[1, "valid"] == (73, 79)
    scored = forecast.cv_series(series(spark, range(100)), forecast.naive_forecaster(), h=7, windows=3, step=10)
    assert scored.count() == 21 and scored.agg(F.max(F.col("y") - F.col("y_hat"))).first()[0] == 7.0


def test_leaderboard_and_best_method(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.8)], "model string, rmsle double")
    rows = evaluate.leaderboard(scores).orderBy("position").collect()
    assert [r["model"] for r in rows] == ["b", "a", "c"] and rows[0]["improvement_percent"] == pytest.approx(50.0)
    table = spark.createDataFrame(
        [("BottomUp", "Total", 100.0), ("TopDown", "Total", 80.0), ("MinTrace", "Total", 90.0),
         ("BottomUp", "Store", 60.0), ("TopDown", "Store", 70.0), ("MinTrace", "Store", 40.0)], "method string, level string, rmse double")
    assert evaluate.best_method(table, level="Total").first()["method"] == "TopDown"
    assert evaluate.best_method(table, level="Store").first()["method"] == "MinTrace"
    assert evaluate.best_method(table).first()["method"] == "MinTrace"
    assert evaluate.best_method(table, level="None").count() == 0


def test_prediction_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 100.0)], "k int, y_hat double")
    b = spark.createDataFrame([(1, 1.0005), (2, 100.0)], "k int, y_hat double")
    assert evaluate.compare_predictions(a, b, ["k"]).first()["all_close"]
    assert not evaluate.compare_predictions(a, b.where("k = 1"), ["k"]).first()["all_close"]


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = {r["gate"]: r for r in gates.data_gates(df, 0.2, 2, ["a", "z"]).collect()}
    assert rows["data_null_ratio"]["value"] == 0.25 and not rows["data_null_ratio"]["passed"]
    assert rows["data_row_count"]["passed"] and not rows["required_columns"]["passed"] and rows["required_columns"]["note"] == "z"
    none = spark.createDataFrame([(None, 0.4)], "final_rmsle double, cv_rmsle double")
    assert gates.model_gate(none, 0.5).first()["value"] == 0.4
    assert not gates.model_gate(none.where("false"), 0.5).first()["passed"]
    nodes = spark.createDataFrame([("Total", 0.0), ("Store", 0.0)], "level string, y_hat double")
    gate = gates.recon_gate(nodes, 0.01)
    assert gate.first()["passed"] and gate.first()["value"] is None
    report = gates.quality_report(gate, gates.model_gate(none, 0.3))
    assert {r["all_passed"] for r in report.collect()} == {False}


def test_artifacts(spark, tmp_path):
    (tmp_path / "there").mkdir()
    rows = gates.artifact_gates(spark, [str(tmp_path / "there"), str(tmp_path / "gone")], [str(tmp_path / "maybe")]).collect()
    assert [r["passed"] for r in rows] == [True, False, True]
