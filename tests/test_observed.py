import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleswright.operators.clean import warmup_counts
from saleswright.plans import stages
from saleswright.plans.features import window_features
from saleswright.streaming import sketches

SCHEMA = "date date, store_nbr int, family string, sales double, onpromotion long"
START = dt.date(2024, 1, 1)


def sales(spark, missing=()):
    rows = [(START + dt.timedelta(days=i), s, "A", None if (i, s) in missing else float(i - 20), 0) for i in range(120) for s in (1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_come_from_the_writing_job(spark, tmp_path):
    context = spark.sparkContext
    raw = sales(spark, {(3, 1), (50, 2)})
    raw.write.parquet(str(tmp_path / "raw"))
    context.setJobGroup("observed", "one job")
    counts = stages.write_clean_sales(spark.read.schema(raw.schema).parquet(str(tmp_path / "raw")), str(tmp_path / "clean"), nulls="drop")
    jobs = context.statusTracker().getJobIdsForGroup("observed")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert counts == {"n_rows": 240, "n_negative": 39, "first": START, "last": START + dt.timedelta(days=119), "null_date": 0, "null_store_nbr": 0,
                      "null_family": 0, "null_sales": 2, "n_written": 238}
    held = spark.read.parquet(str(tmp_path / "clean"))
    assert held.count() == 238 and held.where("sales < 0").count() == 0


def test_a_null_fails_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="null value in column sales"):
        stages.write_clean_sales(sales(spark, {(3, 1)}), str(tmp_path / "clean"))
    kept = stages.write_clean_sales(sales(spark, {(3, 1)}), str(tmp_path / "kept"), nulls="keep")
    assert kept["null_sales"] == 1 and kept["n_written"] == 240
    with pytest.raises(ValueError):
        stages.write_clean_sales(sales(spark), str(tmp_path / "x"), nulls="ignore")


@pytest.mark.parametrize("calendar", [None, "zero"])
def test_dropped_rows_are_counted_ahead_of_the_drop(spark, tmp_path, calendar):
    fact = sales(spark)
    counts = stages.write_features(fact, {}, str(tmp_path / "features"), 28, calendar=calendar)
    expected = warmup_counts(window_features(fact, 28), 28).first()
    assert counts == {"n_rows": 240, "n_dropped": expected["n_dropped"], "n_written": expected["n_kept"]}
    assert spark.read.parquet(str(tmp_path / "features")).count() == counts["n_written"]


def events(spark, n=20_000):
    return spark.range(n).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 30).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("endpoint"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000).alias("seconds"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("user_id"))


def test_merged_sketches_keep_their_bounds(spark):
    told = events(spark).withColumn("all", F.lit(1))
    whole = sketches.merged(sketches.window_sketches(told, "seconds", "user_id", ["all", "endpoint"]), ["all"])
    found = sketches.rank_within(sketches.quantiles_of(whole, (0.01, 0.5, 0.99), ["all"]), told, "seconds", ["all"], sketches.rank_error())
    assert [r["within"] for r in found.collect()] == [True] * 3
    n = told.select("user_id").distinct().count()
    assert abs(sketches.distinct_of(whole).first()["n_distinct"] - n) <= n * sketches.distinct_error()


def test_a_wrong_quantile_is_seen(spark):
    told = events(spark, 2000).withColumn("all", F.lit(1))
    wrong = spark.createDataFrame([(1, 0.5, 90.0), (1, 0.9, 90.0)], "all int, q double, value double")
    found = {r["q"]: r["within"] for r in sketches.rank_within(wrong, told, "seconds", ["all"], sketches.rank_error()).collect()}
    assert found == {0.5: False, 0.9: False} or found == {0.5: False, 0.9: True}


def test_windows_without_values(spark):
    none = events(spark, 10).withColumn("seconds", F.lit(None).cast("double"))
    rows = sketches.window_sketches(none, "seconds", "user_id", ["endpoint"])
    assert sketches.quantiles_of(rows, (0.5,), ["endpoint"]).count() == 0
