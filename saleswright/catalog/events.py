"""Service-level aggregates over the event table: windows, histograms, quantiles, alerts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BATCH_SIZE_BOUNDS, LATENCY_BOUNDS
from ..operators.facts import exact_quantiles
from ..sources.sample import shape_events
from ..streaming import run, slo
from . import base
from .base import define, naive, r, rounded, sql_table

HOUR = "1 hour"
LATE = "10 minutes"


def e1_request_rates(spark, sf_dir):
    return naive(slo.request_rates(base.events(spark, sf_dir), HOUR))


def _stream(spark, sf_dir) -> DataFrame:
    return shape_events(run.event_stream(spark, sf_dir))


def e1_request_rates_stream(spark, sf_dir):
    """The same operator on a stream: every window the watermark has passed."""
    table, _ = run.drain(slo.request_rates(_stream(spark, sf_dir), HOUR, late=LATE), "request_rates")
    return naive(table)


def e2_sliding_rate(spark, sf_dir):
    rates = slo.sliding_rate(base.events(spark, sf_dir), HOUR, "30 minutes")
    return naive(rounded(rates, 8, "rate"))


def _latency(spark, sf_dir) -> DataFrame:
    return slo.latency_histogram(base.events(spark, sf_dir))


def e3_latency_buckets(spark, sf_dir):
    return _latency(spark, sf_dir).withColumn("le", F.when(F.col("le") == float("inf"), F.lit(-1.0)).otherwise(F.col("le")))


def e4_bucket_quantiles(spark, sf_dir):
    parts = [
        rounded(slo.bucket_quantile(_latency(spark, sf_dir), q), 6, "value").withColumn("q", F.lit(q)) for q in (0.5, 0.95, 0.99)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def e4_exact_quantiles(spark, sf_dir):
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return rounded(exact_quantiles(base.events(spark, sf_dir), "seconds", wanted, ["endpoint"]), 8, *wanted)


def e4_approximate_quantiles(spark, sf_dir):
    return base.events(spark, sf_dir).groupBy("endpoint").agg(F.percentile_approx("seconds", [0.5, 0.95, 0.99], 10000).alias("quantiles"))


def e5_error_ratio(spark, sf_dir):
    return naive(rounded(slo.error_ratio(base.events(spark, sf_dir), HOUR), 8, "ratio"))


def e6_cache_hit_ratio(spark, sf_dir):
    ratios = slo.label_ratio(base.events(spark, sf_dir), "cache", "hit", 0.5, below=True, width=HOUR)
    return naive(rounded(ratios, 8, "ratio"))


def e6_zero_fallback_ratio(spark, sf_dir):
    ratios = slo.label_ratio(base.events(spark, sf_dir), "lookup", "zero_fallback", 0.2, width=HOUR)
    return naive(rounded(ratios, 8, "ratio"))


def _hourly(spark, sf_dir) -> DataFrame:
    return slo.windowed(base.events(spark, sf_dir), {"n_requests": F.count(F.lit(1))}, (), HOUR)


def e7_rate_drop(spark, sf_dir):
    return naive(rounded(slo.rate_drop(_hourly(spark, sf_dir)), 8, "ratio"))


def e7_rate_drop_stream(spark, sf_dir):
    table, _ = run.drain(slo.rate_drop_stream(_stream(spark, sf_dir), HOUR, HOUR, late=LATE), "rate_drop")
    return naive(rounded(table, 8, "ratio"), "window_start")


def e8_absent_windows(spark, sf_dir):
    return naive(slo.absent_windows(base.events(spark, sf_dir), 2), "window_start")


def e9_sustained_alerts(spark, sf_dir):
    alerts = slo.label_ratio(base.events(spark, sf_dir), "cache", "hit", 0.4, below=True, width=HOUR)
    return naive(slo.sustained(alerts, 3, 60), "run_start", "run_end")


def e10_threshold_alerts(spark, sf_dir):
    events = base.events(spark, sf_dir)
    counts = slo.windowed(
        events, {"rejections": F.count_if(F.col("status") == 500), "connections": F.count_distinct("user_id")}, (), HOUR
    )
    long = counts.select(
        "window_start", "window_end",
        F.inline(F.array(
            F.struct(F.lit("rejections").alias("metric"), F.col("rejections").cast("double").alias("value")),
            F.struct(F.lit("connections").alias("metric"), F.col("connections").cast("double").alias("value")),
        )),
    )
    return naive(slo.threshold_alerts(long, {"rejections": 4.0, "connections": 15.0}))


def e11_value_buckets(spark, sf_dir):
    sized = base.events(spark, sf_dir).withColumn("size", F.ceil(F.col("seconds") * 1000))
    buckets = slo.latency_histogram(sized, BATCH_SIZE_BOUNDS, "size", ("method",))
    return buckets.withColumn("le", F.when(F.col("le") == float("inf"), F.lit(-1.0)).otherwise(F.col("le")))


def e12_deduplicated(spark, sf_dir):
    events = base.events(spark, sf_dir).select("event_id", "user_id", "ts", "endpoint", "method")
    return naive(slo.dedupe_requests(events, ["user_id", "endpoint"]), "ts")


def e12_deduplicated_stream(spark, sf_dir):
    events = _stream(spark, sf_dir).select("event_id", "user_id", "ts", "endpoint")
    table, _ = run.drain(slo.dedupe_requests(events, ["user_id", "endpoint"]), "deduplicated")
    return naive(table, "ts").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n_requests"))


def e13_late_events(spark, sf_dir):
    """The later days arrive first; the earlier ones then are behind the watermark, dropped and counted."""
    from ..session import scratch_dir
    from ..sources.sample import table

    folder, out = scratch_dir(spark, "arrivals"), scratch_dir(spark, "late_rates")
    raw = table(spark, sf_dir, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    stream = spark.readStream.schema(raw.schema).option("recursiveFileLookup", True).parquet
    dropped = 0
    for name, part in (("late", F.col("ts") >= middle), ("early", F.col("ts") < middle)):
        raw.where(part).write.parquet(f"{folder}/{name}")
        counts, progress = run.drain(slo.request_rates(shape_events(stream(folder)), HOUR, late=LATE), "late_rates", out=out)
        dropped += run.dropped_by_watermark(progress)
    return counts.agg(F.sum("n_requests").alias("n_counted")).withColumn("any_dropped", F.lit(dropped > 0))


QUERIES = {
    f.__name__: f
    for f in (
        e1_request_rates, e1_request_rates_stream, e2_sliding_rate, e3_latency_buckets, e4_bucket_quantiles, e4_exact_quantiles,
        e4_approximate_quantiles, e5_error_ratio, e6_cache_hit_ratio, e6_zero_fallback_ratio, e7_rate_drop, e7_rate_drop_stream,
        e8_absent_windows, e9_sustained_alerts, e10_threshold_alerts, e11_value_buckets, e12_deduplicated, e12_deduplicated_stream,
        e13_late_events,
    )
}

define("hours", "SELECT *, date_trunc('hour', ts) AS h FROM events_shaped")
define("hourly", "SELECT h, count(*) AS n FROM hours GROUP BY h")


def _buckets(bounds, value: str, by: str, source: str) -> str:
    parts = [f"SELECT {by}, CAST({le} AS DOUBLE) AS le, count(*) FILTER (WHERE {value} <= {le}) AS n FROM {source} GROUP BY {by}" for le in bounds]
    parts.append(f"SELECT {by}, CAST(-1 AS DOUBLE) AS le, count(*) AS n FROM {source} GROUP BY {by}")
    return " UNION ALL ".join(parts)


define("latency", _buckets(LATENCY_BOUNDS, "seconds", "endpoint", "events_shaped"))
define("latency_steps", """
SELECT endpoint, le, n, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(n) OVER (PARTITION BY endpoint) AS total
FROM (SELECT endpoint, CASE WHEN le < 0 THEN 'infinity'::DOUBLE ELSE le END AS le, n FROM latency) WINDOW w AS (PARTITION BY endpoint ORDER BY le)""")

_END = "window_start + INTERVAL 1 HOUR AS window_end"


def _ratio(column: str, value: str, test: str) -> str:
    return f"""
SELECT window_start, {_END}, n_matching, n_labelled, round(n_matching / n_labelled, 8) AS ratio, n_matching / n_labelled {test} AS firing
FROM (SELECT h AS window_start, count(*) FILTER (WHERE {column} = '{value}') AS n_matching, count({column}) AS n_labelled FROM hours GROUP BY h)"""


_RATES = f"""
SELECT h AS window_start, h + INTERVAL 1 HOUR AS window_end, endpoint, method, status, count(*) AS n_requests FROM hours GROUP BY h, endpoint, method, status"""
_DROP = """
SELECT b.h + INTERVAL 1 HOUR AS window_start, {end}coalesce(a.n, 0) AS n_requests, b.n AS before,
       round(coalesce(a.n, 0) / b.n, 8) AS ratio, coalesce(a.n, 0) / b.n < 0.5 AS firing
FROM hourly b LEFT JOIN hourly a ON a.h = b.h + INTERVAL 1 HOUR WHERE b.h + INTERVAL 1 HOUR <= (SELECT max(h) FROM hourly)"""

SQL = sql_table(
    e1_request_rates=_RATES,
    e1_request_rates_stream=f"SELECT * FROM ({_RATES}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    e2_sliding_rate="""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n_requests, round(count(*) / 3600, 8) AS rate
FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
GROUP BY window_start""",
    e3_latency_buckets="SELECT * FROM latency",
    e4_bucket_quantiles="""
SELECT endpoint, q, round(min_by(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (q * total - below) / (n - below) END, le), 6) AS value
FROM latency_steps, (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)) t(q) WHERE n >= q * total AND n > below GROUP BY endpoint, q""",
    e4_exact_quantiles="""
SELECT endpoint, round(quantile_cont(seconds, 0.5), 8) AS p50, round(quantile_cont(seconds, 0.95), 8) AS p95, round(quantile_cont(seconds, 0.99), 8) AS p99
FROM events_shaped GROUP BY endpoint""",
    e5_error_ratio=f"""
SELECT window_start, {_END}, n_errors, n_requests, round(n_errors / n_requests, 8) AS ratio, n_errors / n_requests > 0.01 AS firing
FROM (SELECT h AS window_start, count(*) FILTER (WHERE status >= 500) AS n_errors, count(*) AS n_requests FROM hours GROUP BY h)""",
    e6_cache_hit_ratio=_ratio("cache", "hit", "< 0.5"),
    e6_zero_fallback_ratio=_ratio("lookup", "zero_fallback", "> 0.2"),
    e7_rate_drop=_DROP.format(end="b.h + INTERVAL 2 HOUR AS window_end, "),
    e7_rate_drop_stream=f"SELECT * FROM ({_DROP.format(end='')}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    e8_absent_windows="""
SELECT s AS window_start, 0 AS n_requests FROM (
  SELECT unnest(generate_series(time_bucket(INTERVAL 2 MINUTE, min(ts)), time_bucket(INTERVAL 2 MINUTE, max(ts)), INTERVAL 2 MINUTE)) AS s FROM events)
WHERE s NOT IN (SELECT time_bucket(INTERVAL 2 MINUTE, ts) FROM events)""",
    e9_sustained_alerts=f"""
SELECT min(window_start) AS run_start, max(window_end) AS run_end, count(*) AS n_windows
FROM (SELECT *, epoch(window_start) / 3600 - row_number() OVER (ORDER BY window_start) AS island FROM ({_ratio("cache", "hit", "< 0.4")}) WHERE firing)
GROUP BY island HAVING count(*) >= 3""",
    e10_threshold_alerts=f"""
SELECT window_start, {_END}, metric, value, threshold, value > threshold AS firing FROM (
  SELECT h AS window_start, 'rejections' AS metric, CAST(count(*) FILTER (WHERE status = 500) AS DOUBLE) AS value, CAST(4 AS DOUBLE) AS threshold FROM hours GROUP BY h
  UNION ALL SELECT h, 'connections', CAST(count(DISTINCT user_id) AS DOUBLE), CAST(15 AS DOUBLE) FROM hours GROUP BY h)""",
    e11_value_buckets=_buckets(BATCH_SIZE_BOUNDS, "ceil(seconds * 1000)", "method", "events_shaped"),
    e13_late_events="""
SELECT CAST(count(*) AS BIGINT) AS n_counted, (SELECT count(*) > 0 FROM events WHERE ts < TIMESTAMP '2024-01-16') AS any_dropped FROM hours
WHERE ts >= TIMESTAMP '2024-01-16' AND h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    e12_deduplicated="""
SELECT event_id, user_id, ts, endpoint, method
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, endpoint, h ORDER BY ts, event_id) AS rn FROM hours) WHERE rn = 1""",
)
