"""Inputs that the tables behind the SQL twins do not hold: gaps, repeats, several files, NaN, silence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleswright import session
from saleswright.operators import facts, forecast, requests
from saleswright.sources import files, stages
from saleswright.streaming import slo


def test_newest_version_is_by_number(spark, tmp_path):
    for v in ("v9", "v10", "v2"):
        stages.publish_snapshot(spark.createDataFrame([(v,)], "made string"), str(tmp_path), v)
    newest = stages.refresh_snapshot(spark, str(tmp_path)).first()
    assert newest["made"] == newest["version"] == "v10"
    with pytest.raises(FileNotFoundError):
        stages.refresh_snapshot(spark, str(tmp_path / "none"))


def test_requests_are_numbered_from_one_over_files(spark, tmp_path):
    for part in range(3):
        lines = "".join(f"{part * 4 + i + 1},DAIRY,2017-01-01,15\n" for i in range(4))
        (tmp_path / f"part{part}.csv").write_text("store_nbr,family,date,horizon\n" + lines)
    rows = files.read_requests(spark, str(tmp_path)).collect()
    assert sorted((r["row_id"], r["store_nbr"]) for r in rows) == [(i, i) for i in range(1, 13)]


def test_a_large_file_in_several_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("store_nbr,family,date,horizon\n" + "".join(f"{i},DAIRY,2017-01-01,15\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_requests(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(r["row_id"] == r["store_nbr"] for r in rows)


def test_error_lines_count_from_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("store_nbr,family,date,horizon\n0,DAIRY,2017-01-01,15\n1,DAIRY,2017-01-01,15\n1,NONE,2017-01-01,15\n")
    _, bad = requests.split_requests(requests.validate_requests(files.read_requests(spark, str(tmp_path))))
    assert [r["text"].split(":")[0] for r in requests.error_summary(bad).orderBy("position").collect()] == ["Row 1", "Row 3"]


def test_missing_required_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,store_nbr,family\n2017-01-01,1,DAIRY\n")
    with pytest.raises(ValueError, match="sales"):
        files.read_sales(spark, str(tmp_path))


def test_repeated_feature_rows_give_one_result(spark):
    day = dt.date(2017, 1, 2)
    asked = spark.createDataFrame([(1, "DAIRY", day)], "store_nbr int, family string, date date")
    known = spark.createDataFrame([(1, "DAIRY", day, 3.0), (1, "DAIRY", day, 5.0)], "store_nbr int, family string, date date, x double")
    assert [(r["x"], r["source"]) for r in requests.lookup_features(asked, known, ["x"]).collect()] == [(5.0, "exact")]


def test_nan_counts_as_missing_in_quantiles(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (3.0,)], "v double")
    assert facts.exact_quantiles(rows, "v", {"p50": 0.5}).first()["p50"] == 2.0


def test_gaps_do_not_shift_weekdays(spark):
    """Two days of the last week are missing: each forecast still is the last value of its weekday."""
    first = dt.date(2024, 1, 1)
    rows = [("a", first + dt.timedelta(days=i), float(i)) for i in range(21) if i not in (16, 18)]
    found = forecast.seasonal_naive(spark.createDataFrame(rows, "unique_id string, ds date, y double"), 7).orderBy("ds").collect()
    assert [r["y_hat"] for r in found] == [14.0, 15.0, 9.0, 17.0, 11.0, 19.0, 20.0]


def events(spark, hours):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(hours=h, minutes=m),) for h, n in hours.items() for m in range(n)], "ts timestamp")


def test_a_complete_stop_fires(spark):
    rates = slo.windowed(events(spark, {0: 10, 1: 10, 3: 4}), {"n_requests": F.count(F.lit(1))}, (), "1 hour")
    found = {r["window_start"].hour: (r["n_requests"], r["firing"]) for r in slo.rate_drop(rates).collect()}
    assert found == {1: (10, False), 2: (0, True)}
    later = slo.rate_drop(rates, until=F.lit(dt.datetime(2024, 1, 1, 4))).collect()
    assert {r["window_start"].hour: r["n_requests"] for r in later} == {1: 10, 2: 0, 4: 0}


def test_silence_up_to_now_is_seen(spark):
    table = events(spark, {0: 2})
    assert slo.absent_windows(table, 30).count() == 0
    silent = slo.absent_windows(table, 30, until=F.lit(dt.datetime(2024, 1, 1, 2))).collect()
    assert sorted(r["window_start"].strftime("%H:%M") for r in silent) == ["00:30", "01:00", "01:30"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Elsewhere:
        applicationId = "app"
        master = "spark://host:7077"
        getConf = Unset

    class Session:
        conf = Unset
        sparkContext = Elsewhere

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session, "x")


def test_scratch_folders_go_at_the_end(spark):
    path = stages.write_stage(spark.range(3), session.scratch_dir(spark, "gone"))
    mine = session._MADE.pop(spark.sparkContext.applicationId)
    session._MADE[spark.sparkContext.applicationId] = [path]
    assert session.clear_scratch(spark) == 1 and not stages.path_exists(spark, path)
    session._MADE[spark.sparkContext.applicationId] = [p for p in mine if p != path]
