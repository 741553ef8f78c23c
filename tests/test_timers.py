"""Stateful stream operators: equal to their batch forms however the events are cut into micro-batches."""

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saleswright.streaming import run, slo, spans, states

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, ts timestamp, endpoint string, cache string"


def made(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s), e, c) for i, (s, e, c) in enumerate(rows)], SCHEMA)


#: Four hours; "b" falls silent after the first, "a" has a run of misses and a gap.
ROWS = [(s, "a", "miss" if 1800 <= s < 7200 or s % 50 == 0 else "hit") for s in range(0, 9000, 20)] + [(s, "b", "hit") for s in range(0, 3000, 30)]
ROWS += [(s, "a", "hit") for s in range(10800, 14400, 25)]


def drained(spark, tmp_path, rows, cuts, build, name):
    """Rows in time order, in ``cuts`` parts; the stream goes on with each part that arrives."""
    rows = sorted(rows)
    size = -(-len(rows) // cuts)
    frame = made(spark, rows).cache()
    for i in range(cuts):
        frame.where(F.col("event_id").between(i * size, (i + 1) * size - 1)).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        table, _ = run.drain(build(stream), name, out=str(tmp_path / "out"), settings=states.STORE)
    until = frame.agg((F.max("ts") - F.expr("interval 10 minutes")).alias("u")).scalar()
    return table, frame, until


def same(a, b):
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("cuts", [3])
def test_a_silent_service_is_reported(spark, tmp_path, cuts):
    table, events, until = drained(spark, tmp_path, ROWS, cuts, lambda e: states.silence_stream(e, 2, ["endpoint"]), "silence")
    same(table, states.silence_rows(events, 2, until, ["endpoint"]))
    silent = {r["endpoint"]: r["count"] for r in table.groupBy("endpoint").count().collect()}
    assert silent["b"] > 80  # long after its last event, on the watermark of the others
    assert silent["a"] == 15  # half an hour


def test_silence_of_the_whole_service(spark, tmp_path):
    table, events, until = drained(spark, tmp_path, ROWS, 2, lambda e: states.silence_stream(e, 2), "silence_all")
    batch = states.silence_rows(events, 2, until)
    same(table, batch)
    closed = slo.absent_windows(events, 2).select("window_start").where(F.col("window_start") + F.expr("interval 2 minutes") <= until)
    same(batch, closed)


@pytest.mark.parametrize("cuts", [4])
def test_alerts_that_hold(spark, tmp_path, cuts):
    build = lambda e: states.sustained_stream(e, F.col("hits") / F.col("n") < 0.5, {"hits": F.count_if(F.col("cache") == "hit"), "n": F.count("cache")}, 3, 5, ["endpoint"])
    table, events, until = drained(spark, tmp_path, ROWS, cuts, build, "sustained")
    alerts = slo.label_ratio(events, "cache", "hit", 0.5, below=True, width="5 minutes")
    per = slo.windowed(events, {"hits": F.count_if(F.col("cache") == "hit"), "n": F.count("cache")}, ["endpoint"], "5 minutes")
    batch = states.sustained_rows(per.withColumn("firing", F.col("hits") / F.col("n") < 0.5), 3, 5, until, ["endpoint"])
    same(table, batch)
    found = {(r["state"], (r["at"] - r["run_start"]).seconds // 300, r["n_windows"]) for r in table.collect()}
    assert ("firing", 3, 3) in found and ("resolved", 18, 18) in found and alerts.count() > 0


def test_a_run_without_a_following_window_ends_by_the_watermark(spark, tmp_path):
    rows = [(s, "a", "miss") for s in range(0, 1800, 10)] + [(s, "b", "hit") for s in range(0, 7200, 60)]
    build = lambda e: states.sustained_stream(e, F.col("hits") < 1, {"hits": F.count_if(F.col("cache") == "hit")}, 2, 5, ["endpoint"])
    table, _, _ = drained(spark, tmp_path, rows, 3, build, "ended")
    assert {(r["endpoint"], r["state"], r["n_windows"]) for r in table.collect()} == {("a", "firing", 2), ("a", "resolved", 6)}


def chain(rows, ttl):
    kept, last = set(), {}
    for i, (s, e, _) in enumerate(rows):
        if e not in last or s >= last[e] + ttl:
            last[e] = s
            kept.add(i)
    return kept


@pytest.mark.parametrize("ttl", [60, 3600])
def test_spans_begin_with_the_request(spark, ttl):
    rows = sorted([*ROWS, (0, "a", "hit"), (0, "a", "miss"), (20_000, None, "hit"), (20_001, None, "hit")], key=lambda r: (r[0], str(r[1]), r[2]))
    found = spans.first_of_spans(made(spark, rows), ["endpoint"], ttl)
    assert {r["event_id"] for r in found.collect()} == chain(rows, ttl)
    assert spans.first_of_spans(made(spark, rows).where("false"), ["endpoint"], ttl).count() == 0


def test_a_long_chain_of_one_key(spark):
    rows = [(i * 7, "hot", "hit") for i in range(5000)] + [(i * 100, f"k{i % 50}", "hit") for i in range(500)]
    rows.sort()
    found = spans.first_of_spans(made(spark, rows), ["endpoint"], 20)
    assert {r["event_id"] for r in found.collect()} == chain(rows, 20)


def test_chains_cost_their_events_and_not_their_squares(spark, monkeypatch):
    written = []
    keep = spans.materialised
    monkeypatch.setattr(spans, "materialised", lambda df, name: written.append((name, df._jdf.queryExecution().toString(), keep(df, name))) or written[-1][2])
    rows = sorted((s, "abc"[s % 3], "hit") for s in range(3000))
    found = spans.first_of_spans(made(spark, rows), ["endpoint"], 30)
    assert {r["event_id"] for r in found.collect()} == chain(rows, 30)
    assert not any("unboundedfollowing" in plan.lower() for _, plan, _ in written)  # such a frame is summed up anew for each row
    assert sum(df.count() for name, _, df in written if name == "links") < 3 * len(rows)


class Held:
    """A state, and the handle that gives it."""

    def __init__(self):
        self.rows, self.timers = [], set()
        self.getValueState = self.getListState = lambda *_: self
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[-1]

    def update(self, row):
        self.rows = [row]

    def appendList(self, rows):
        self.rows = self.rows or [(0, 0, 0)]


def test_a_busy_key_of_a_stream_holds_numbers_only():
    held, n = spans.Spans(["endpoint"], 60_000_000), 300_000
    held.init(Held())
    frames = (pd.DataFrame({"us": np.arange(i, i + 10_000) * 1000 + 1, "event_id": np.arange(i, i + 10_000)}) for i in range(0, n, 10_000))
    tracemalloc.start()
    found = list(held.handleInputRows(("a",), frames, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n
    assert found[0]["event_id"].tolist() == list(range(0, n, 60_000))


@pytest.mark.parametrize("cuts", [1, 3])
def test_spans_of_a_stream(spark, tmp_path, cuts):
    table, events, until = drained(spark, tmp_path, ROWS, cuts, lambda e: spans.first_of_spans_stream(e, ["endpoint"], 900), "spans")
    same(table, spans.first_of_spans(events, ["endpoint"], 900).where(F.col("ts") <= until).select(table.columns))


def test_events_are_counted_as_late_or_kept(spark, tmp_path):
    parts = [[(7200, "a", "hit"), (7300, "a", "hit")], [(0, "a", "hit"), (10, "b", "hit"), (7000, "a", "hit"), (7400, "a", "hit")], [(90_000, "a", "hit")], [(80_000, "a", "hit")]]
    out, seen = None, []
    for i, part in enumerate(parts):
        made(spark, part).withColumn("event_id", F.col("event_id") + 100 * i).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        count = lambda e: slo.windowed(e, {"n": F.count(F.lit(1))}, (), "1 hour", late="10 minutes")
        table, out, counts = run.drain_counted(stream, count, "1 hour", "counted", out)
        seen.append((counts["n_events"], counts["n_late"], counts["n_kept"]))
    # 7,000 s is behind the watermark of 6,700 s by nothing but its window is still open.
    assert seen == [(2, 0, 2), (4, 2, 2), (1, 0, 1), (1, 1, 0)]
    assert table.agg(F.sum("n")).first()[0] == 4  # the window of the last event is open
