import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleswright.constants import FAMILIES
from saleswright.functions import text
from saleswright.operators import requests as ops
from saleswright.plans.batch import batch_predict, batch_predict_files
from saleswright.sources import files, stages


def requests(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, store_nbr int, family string, date string, horizon int")


def test_first_broken_rule_decides(spark):
    df = requests(
        spark, (1, "BOOKS", "2017-08-01", 30), (0, "NOPE", "x", 1), (1, "", "2017-08-01", 30), (1, "NOPE", "2017-08-01", 30),
        (1, "BOOKS", "", 30), (1, "BOOKS", "08/01/2017", 30), (1, "BOOKS", "2017-02-30", 30), (1, "BOOKS", "2017-08-01", 45),
        (None, "BOOKS", "2017-08-01", 30), (1, None, "2017-08-01", 30), (60, "BOOKS", "2017-08-01", 30),
    )
    codes = [r["code"] for r in ops.validate_requests(df).orderBy("row_id").collect()]
    assert codes == [None, "INVALID_STORE", "MISSING_FAMILY", "INVALID_FAMILY", "MISSING_DATE", "INVALID_DATE", "INVALID_DATE",
                     "INVALID_HORIZON", "INVALID_STORE", "MISSING_FAMILY", None]
    assert ops.validate_requests(df, max_store=54).where("row_id = 10").first()["code"] == "INVALID_STORE"
    assert len(FAMILIES) == 33
    vectors = df.limit(1).select("*", F.explode(F.array(F.lit(0), F.lit(26), F.lit(27))).alias("n")).withColumn("features", F.array_repeat(F.lit(1.0), F.col("n")))
    assert [r["code"] for r in ops.validate_requests(vectors).orderBy("n").collect()] == ["MISSING_FEATURES", "INVALID_FEATURES", None]


def test_error_summary_names_ten_and_counts_the_rest(spark):
    bad = ops.validate_requests(requests(spark, *[(0, "BOOKS", "2017-08-01", 30)] * 13))
    lines = [r["text"] for r in ops.error_summary(ops.split_requests(bad)[1]).orderBy("position").collect()]
    assert len(lines) == 11 and lines[-1] == "... and 3 more errors"


def test_batch_caps(spark):
    many = requests(spark, *[(1, "BOOKS", "2017-08-01", 30)] * 101)
    assert ops.cap_batch(many).count() == 100
    assert ops.cap_batch(many.limit(100), policy="reject").count() == 100
    with pytest.raises(ValueError, match="BATCH_TOO_LARGE"):
        ops.cap_batch(many, policy="reject")
    with pytest.raises(ValueError, match="EMPTY_BATCH"):
        ops.cap_batch(many.where("false"), policy="reject")
    assert ops.batch_size_code(many.where("false")).first()["code"] == "EMPTY_BATCH"


def test_quoted_families_and_odd_headers(spark, tmp_path):
    path = tmp_path / "requests.csv"
    path.write_text(
        ' Date ,STORE_NBR,family,extra,Horizon\n2017-08-01,1,"liquor,wine,beer",x,30\n\n2017-08-02, 2 , books ,y,90\n2017-08-03,abc,BOOKS,z,15days\n'
    )
    rows = files.read_requests(spark, str(path)).orderBy("row_id").collect()
    assert [(r["store_nbr"], r["family"], r["date"], r["horizon"]) for r in rows] == [
        (1, "LIQUOR,WINE,BEER", "2017-08-01", 30), (2, "BOOKS", "2017-08-02", 90), (None, "BOOKS", "2017-08-03", 15)]
    path.write_text("store_nbr,family\n1,BOOKS\n")
    with pytest.raises(ValueError, match="date, horizon"):
        files.read_requests(spark, str(path))


@pytest.fixture(scope="module")
def feats(spark):
    return spark.createDataFrame(
        [(1, "BOOKS", dt.date(2017, 1, 1), 2016.0, None), (1, "BOOKS", dt.date(2017, 1, 2), 2017.0, 4.0)],
        "store_nbr int, family string, date date, year double, sales_lag_7 double",
    )


def test_lookup_falls_back_step_by_step(spark, feats):
    asked = spark.createDataFrame(
        [(1, "BOOKS", dt.date(2017, 1, 1)), (1, "BOOKS", dt.date(2018, 1, 1)), (2, "BOOKS", dt.date(2017, 1, 1))],
        "store_nbr int, family string, date date")
    rows = {r["source"]: r for r in ops.lookup_features(asked, feats, ["year", "sales_lag_7"]).collect()}
    assert rows["exact"]["year"] == 2016.0 and rows["exact"]["sales_lag_7"] == 0.0
    assert rows["aggregated"]["year"] == 2016.5 and rows["aggregated"]["sales_lag_7"] == 2.0
    assert rows["zero_fallback"]["year"] == 0.0


def test_history_prefers_actuals(spark, feats):
    asked = spark.createDataFrame([(0, 1, "BOOKS", dt.date(2017, 1, 15), 0)], "row_id long, store_nbr int, family string, end_date date, days int")
    actual = spark.createDataFrame([(1, "BOOKS", dt.date(2017, 1, 8), 9.0)], "store_nbr int, family string, date date, sales double")
    rows = {str(r["date"]): (r["actual"], r["origin"]) for r in ops.history(asked, actual, feats).collect()}
    assert rows == {"2016-12-18": (2.0, "lag"), "2016-12-25": (2.0, "lag"), "2017-01-08": (9.0, "actual")}


def test_batch_prediction_keeps_every_row(spark, feats):
    asked = requests(spark, (1, "BOOKS", "2017-01-02", 30), (1, "NOPE", "2017-01-02", 30), (5, "BOOKS", "2017-01-02", 30))
    offsets = spark.createDataFrame([(-5.0, 5.0, -9.0, 9.0)], "lower_80_offset double, upper_80_offset double, lower_95_offset double, upper_95_offset double")
    out = batch_predict(asked, feats, ["year", "sales_lag_7"], lambda df: df.withColumn("prediction", F.col("sales_lag_7") * 2), offsets)
    rows = out.orderBy("row_id").collect()
    assert [(r["status"], r["prediction"], r["lower_80"], r["upper_95"]) for r in rows] == [
        ("success", 8.0, 3.0, 17.0), ("error", None, None, None), ("success", 0.0, 0.0, 9.0)]
    assert rows[1]["error"] == "invalid family name: NOPE"
    assert files.batch_export(out).count() == 2 and files.batch_export(out).columns[4:] == list(files.BAND_COLUMNS)


def test_batch_from_file_to_file(spark, feats, tmp_path):
    (tmp_path / "in.csv").write_text("store_nbr,family,date,horizon\n1,BOOKS,2017-01-02,30\n55,BOOKS,2017-01-02,30\n")
    offsets = spark.createDataFrame([(-5.0, 5.0, -9.0, 9.0)], "lower_80_offset double, upper_80_offset double, lower_95_offset double, upper_95_offset double")
    score = lambda df: df.withColumn("prediction", F.col("sales_lag_7") * 2)
    out = batch_predict_files(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), feats, ["year", "sales_lag_7"], score, offsets)
    assert [(r["row_id"], r["status"], r["error"]) for r in out.orderBy("row_id").collect()] == [
        (1, "success", None), (2, "error", "store_nbr must be between 1 and 54")]
    written = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [(r["store_nbr"], r["prediction"]) for r in written] == [("1", "8.00")]


def test_external_files_are_optional(spark, tmp_path):
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2017-01-01,\n2017-01-02,52.5\n")
    found = files.read_external(spark, str(tmp_path))
    assert list(found) == ["oil"] and [r["dcoilwtico"] for r in found["oil"].orderBy("date").collect()] == [None, 52.5]
    with pytest.raises(FileNotFoundError, match="write_stage"):
        stages.read_features(spark, str(tmp_path / "none"))


def test_snapshot_states(spark, feats):
    now, then = F.lit("2017-01-03 12:00:00").cast("timestamp"), F.lit("2017-01-02 11:00:00").cast("timestamp")
    meta = stages.snapshot_metadata(feats, "v7")
    row = stages.snapshot_health(meta, now, then).first()
    assert (row["status"], row["age_hours"], row["data_age_hours"], row["row_count"]) == ("stale", 25, 36, 2)
    assert stages.snapshot_health(meta, now, F.lit("2017-01-03 00:00:00").cast("timestamp")).first()["status"] == "healthy"
    assert stages.snapshot_health(stages.snapshot_metadata(feats.where("false"), "v0"), now, then).first()["status"] == "not loaded"


def test_formats(spark):
    df = spark.createDataFrame([(1234567.0,), (-4321.0,), (12.4,), (None,)], "v double")
    rows = df.select(text.format_money(F.col("v")).alias("m"), text.format_money(F.col("v"), 1, signed=True).alias("s"),
                     text.format_dollars(F.col("v")).alias("d"), text.cell(F.col("v")).alias("c")).collect()
    assert [r["m"] for r in rows] == ["$1.23M", "$-4321", "$12", None]
    assert [r["s"] for r in rows] == ["$1.23M", "$-4.3K", "$12", None]
    assert [r["d"] for r in rows] == ["$1,234,567", "-$4,321", "$12", None]
    assert [r["c"] for r in rows] == ["1234567.00", "-4321.00", "12.40", ""]
