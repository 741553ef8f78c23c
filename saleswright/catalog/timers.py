"""Alerts and silence by state and timer, exact lifetimes, and late events counted, on streams that arrive in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.sample import shape_events, table
from ..streaming import run, slo, spans, states
from . import base
from .base import define, naive, sql_table

HOUR, LATE = "1 hour", "10 minutes"
#: Days from which the parts of a stream begin; the second arrives after the first.
IN_ORDER = (("2000-01-01", "2024-01-12"), ("2024-01-12", "2100-01-01"))
SHUFFLED = (("2024-01-16", "2024-01-20"), ("2000-01-01", "2024-01-08"), ("2024-01-20", "2100-01-01"), ("2024-01-08", "2024-01-16"))


def _arriving(spark, sf_dir, parts, name: str):
    """After each part has been written: the stream over all that has arrived."""
    raw, folder = table(spark, sf_dir, "events"), scratch_dir(spark, name)
    for i, (first, end) in enumerate(parts):
        ts = F.col("ts")
        raw.where((ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))).write.parquet(f"{folder}/{i}")
        yield shape_events(spark.readStream.schema(raw.schema).option("recursiveFileLookup", True).parquet(folder))


def _drained(spark, sf_dir, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The table of a stateful stream whose input arrives in two parts; the second run goes on with the state of the first."""
    out = scratch_dir(spark, name)
    for events in _arriving(spark, sf_dir, IN_ORDER, "arrivals"):
        found, _ = run.drain(build(events), name, out=out, settings=states.STORE)
    return found


def _until(events: DataFrame):
    """The last watermark of a stream over these events."""
    return events.agg(F.timestamp_millis(F.unix_millis(F.max("ts")) - 600_000).alias("until")).scalar()


def e8_silent_endpoints(spark, sf_dir):
    events = base.events(spark, sf_dir)
    return naive(states.silence_rows(events, 2, _until(events), ["endpoint"]), "window_start")


def e8_silent_endpoints_stream(spark, sf_dir):
    return naive(_drained(spark, sf_dir, lambda events: states.silence_stream(events, 2, ["endpoint"], LATE), "silence"), "window_start")


def e9_sustained_states(spark, sf_dir):
    events = base.events(spark, sf_dir)
    alerts = slo.label_ratio(events, "cache", "hit", 0.4, below=True, width=HOUR)
    return naive(states.sustained_rows(alerts, 3, 60, _until(events)), "run_start", "at")


def e9_sustained_states_stream(spark, sf_dir):
    counts = {"n_matching": F.count_if(F.col("cache") == "hit"), "n_labelled": F.count("cache")}
    fires = F.try_divide(F.col("n_matching"), F.col("n_labelled")) < 0.4
    return naive(_drained(spark, sf_dir, lambda events: states.sustained_stream(events, fires, counts, 3, 60, late=LATE), "sustained"), "run_start", "at")


def e12_exact_lifetime(spark, sf_dir):
    events = base.events(spark, sf_dir).select("event_id", "user_id", "ts", "endpoint", "method")
    return naive(spans.first_of_spans(events, ["endpoint"]), "ts")


def e12_exact_lifetime_stream(spark, sf_dir):
    return naive(_drained(spark, sf_dir, lambda events: spans.first_of_spans_stream(events, ["endpoint"], late=LATE), "lifetimes"), "ts")


def e13_counted_events(spark, sf_dir):
    """Parts that arrive out of order: events, late and kept ones of each, and what the closed windows count by then."""
    out, rows = None, []
    for i, events in enumerate(_arriving(spark, sf_dir, SHUFFLED, "arrivals")):
        counts, out, seen = run.drain_counted(events, lambda e: slo.request_rates(e, HOUR, late=LATE), HOUR, "counted", out)
        closed = counts.agg(F.coalesce(F.sum("n_requests"), F.lit(0)).alias("n")).first()["n"]
        rows.append((i + 1, seen["n_events"], seen["n_late"], seen["n_kept"], closed))
    return spark.createDataFrame(rows, "run int, n_events long, n_late long, n_kept long, n_counted long")


QUERIES = {
    f.__name__: f
    for f in (
        e8_silent_endpoints, e8_silent_endpoints_stream, e9_sustained_states, e9_sustained_states_stream, e12_exact_lifetime,
        e12_exact_lifetime_stream, e13_counted_events,
    )
}

define("last_watermark", "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS until FROM events")
define("heard", "SELECT DISTINCT endpoint, time_bucket(INTERVAL 2 MINUTE, ts) AS s FROM events_shaped")
define("closed_alerts", """
SELECT window_start, epoch(window_start) / 3600 - row_number() OVER (ORDER BY window_start) AS island, until
FROM (SELECT h AS window_start FROM hours GROUP BY h HAVING count(*) FILTER (WHERE cache = 'hit') / count(cache) < 0.4), last_watermark
WHERE window_start + INTERVAL 1 HOUR <= until""")
define("alert_runs", "SELECT min(window_start) AS run_start, count(*) AS n, any_value(until) AS until FROM closed_alerts GROUP BY island HAVING count(*) >= 3")

_SILENT = """
SELECT endpoint, s AS window_start FROM (
  SELECT endpoint, unnest(generate_series(min(s), time_bucket(INTERVAL 2 MINUTE, until) - INTERVAL 2 MINUTE, INTERVAL 2 MINUTE)) AS s
  FROM heard, last_watermark GROUP BY endpoint, until) spine
WHERE NOT EXISTS (SELECT 1 FROM heard WHERE heard.endpoint = spine.endpoint AND heard.s = spine.s)"""
_RUNS = """
SELECT run_start, run_start + INTERVAL 3 HOUR AS at, 'firing' AS state, CAST(3 AS BIGINT) AS n_windows FROM alert_runs
UNION ALL
SELECT run_start, run_start + to_hours(CAST(n AS INTEGER)) AS at, 'resolved' AS state, n AS n_windows FROM alert_runs
WHERE run_start + to_hours(CAST(n + 1 AS INTEGER)) <= until"""


def _chain(columns: str, where: str) -> str:
    """By recursion: the first request of an endpoint, then each time the first an hour or more after the last one."""
    return f"""
WITH RECURSIVE times AS (SELECT event_type AS endpoint, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
following AS MATERIALIZED (SELECT a.endpoint, a.ts, b.ts AS next_ts, b.event_id AS next_id FROM times a ASOF JOIN times b ON a.endpoint = b.endpoint AND a.ts + INTERVAL 1 HOUR <= b.ts),
kept AS (
  SELECT endpoint, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM times GROUP BY endpoint
  UNION ALL
  SELECT k.endpoint, f.next_ts, f.next_id FROM kept k JOIN following f ON f.endpoint = k.endpoint AND f.ts = k.ts)
SELECT {columns} FROM kept k JOIN events e ON e.event_id = k.event_id{where}"""


_PART = "CASE " + " ".join(f"WHEN ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' THEN {i + 1}" for i, (a, b) in enumerate(SHUFFLED)) + " END"
_COUNTED = """
SELECT CAST(r.run AS INTEGER) AS run, r.n_events, r.n_late, r.n_events - r.n_late AS n_kept,
  (SELECT count(*) FROM marked m WHERE m.run <= r.run AND NOT m.late AND m.over <= r.after) AS n_counted
FROM (SELECT run, any_value(after) AS after, count(*) AS n_events, count(*) FILTER (late) AS n_late FROM marked GROUP BY run) r"""
define("arrived", f"SELECT {_PART} AS run, h + INTERVAL 1 HOUR AS over, ts FROM hours")
define("watermarks", """
SELECT run, lag(after) OVER (ORDER BY run) AS before, after
FROM (SELECT run, max(max(ts)) OVER (ORDER BY run) - INTERVAL 10 MINUTE AS after FROM arrived GROUP BY run)""")
define("marked", "SELECT a.run, a.over, w.after, coalesce(a.over <= w.before, false) AS late FROM arrived a JOIN watermarks w ON w.run = a.run")

SQL = sql_table(
    e8_silent_endpoints=_SILENT,
    e8_silent_endpoints_stream=_SILENT,
    e9_sustained_states=_RUNS,
    e9_sustained_states_stream=_RUNS,
    e13_counted_events=_COUNTED,
) | {
    "e12_exact_lifetime": _chain("e.event_id, e.user_id, e.ts, k.endpoint, CASE WHEN k.endpoint = 'view' THEN 'GET' ELSE 'POST' END AS method", ""),
    "e12_exact_lifetime_stream": _chain("k.endpoint, e.ts, e.event_id", " WHERE e.ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"),
}
