import datetime as dt

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from saleswright.sources.sample import request_events, shape_events
from saleswright.streaming import run, slo


def events(spark, *rows):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame(
        [(i, start + dt.timedelta(seconds=s), e, "GET", status, seconds) for i, (s, e, status, seconds) in enumerate(rows)],
        "event_id long, ts timestamp, endpoint string, method string, status int, seconds double")


def test_rates_and_ratios(spark):
    ev = events(spark, (0, "a", 200, 0.1), (10, "a", 500, 0.1), (310, "a", 200, 0.1))
    counts = slo.request_rates(ev).orderBy("window_start", "status").collect()
    assert [r["n_requests"] for r in counts] == [1, 1, 1]
    ratios = slo.error_ratio(ev).orderBy("window_start").collect()
    assert [(r["ratio"], r["firing"]) for r in ratios] == [(0.5, True), (0.0, False)]
    sliding = slo.sliding_rate(ev, "5 minutes", "1 minute")
    assert sliding.agg(F.sum("n_requests")).first()[0] == 15


def test_bucket_quantile_interpolates(spark):
    ev = events(spark, *[(i, "a", 200, s) for i, s in enumerate([0.0005] * 50 + [0.003] * 40 + [7.0] * 10)])
    hist = slo.latency_histogram(ev)
    value = lambda q: slo.bucket_quantile(hist, q).first()["value"]
    assert value(0.25) == pytest.approx(0.0005)
    assert value(0.7) == pytest.approx(0.001 + 0.004 * 20 / 40)
    assert value(0.99) == 5.0
    assert slo.bucket_quantile(slo.latency_histogram(ev.withColumn("seconds", F.lit(None).cast("double"))), 0.5).first()["value"] is None


def test_absent_windows_and_sustained_alerts(spark):
    ev = events(spark, (0, "a", 200, 0.1), (500, "a", 200, 0.1))
    gaps = slo.absent_windows(ev, 2).orderBy("window_start").collect()
    assert [r["window_start"].minute for r in gaps] == [2, 4, 6]
    flags = [True, True, False, True, True, True]
    rows = [(dt.datetime(2024, 1, 1, 0, 5 * i), dt.datetime(2024, 1, 1, 0, 5 * i + 5), f) for i, f in enumerate(flags)]
    alerts = spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, firing boolean")
    runs = slo.sustained(alerts, 3, 5).collect()
    assert [(r["run_start"].minute, r["run_end"].minute, r["n_windows"]) for r in runs] == [(15, 30, 3)]


def test_stream_equals_batch_up_to_the_watermark(spark):
    stream = slo.request_rates(shape_events(run.event_stream(spark, SMALL)), "1 hour", late="10 minutes")
    table, _ = run.drain(stream, "test_rates")
    batch = slo.request_rates(request_events(spark, SMALL), "1 hour")
    closed = request_events(spark, SMALL).agg(F.max("ts") - F.expr("interval 10 minutes")).scalar()
    expected = batch.where(F.col("window_end") <= closed)
    assert table.count() == expected.count() > 100
    assert table.exceptAll(expected).count() == 0


def test_rate_drop_stream_equals_batch(spark):
    raw = shape_events(run.event_stream(spark, SMALL))
    table, _ = run.drain(slo.rate_drop_stream(raw, "1 hour", "1 hour", late="10 minutes"), "test_drop")
    hourly = slo.windowed(request_events(spark, SMALL), {"n_requests": F.count(F.lit(1))}, (), "1 hour")
    batch = slo.rate_drop(hourly).select(table.columns)
    assert table.count() >= batch.count() - 3 and table.exceptAll(batch).count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    ev = events(spark, (0, "a", 200, 0.1), (7200, "a", 200, 0.1))
    schema = ev.schema
    out = str(tmp_path / "out")
    ev.where("event_id = 1").write.parquet(str(tmp_path / "in/first"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run.drain(slo.request_rates(read(), "1 hour", late="10 minutes"), "late", out=out)
    ev.where("event_id = 0").write.parquet(str(tmp_path / "in/second"))
    table, progress = run.drain(slo.request_rates(read(), "1 hour", late="10 minutes"), "late", out=out)
    assert run.dropped_by_watermark(progress) == 1 and table.count() == 0


def test_repeated_requests_collapse(spark):
    ev = events(spark, (5, "a", 200, 0.1), (0, "a", 200, 0.2), (10, "b", 200, 0.1), (4000, "a", 200, 0.1))
    kept = slo.dedupe_requests(ev, ["endpoint"]).collect()
    assert sorted(r["event_id"] for r in kept) == [1, 2, 3]
