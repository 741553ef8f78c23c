"""Service-level aggregates on request events: ts, endpoint, method, status, seconds, labels.

Windowed aggregates take a batch frame or a stream alike. Give ``late`` (a watermark delay) for a
stream; events later than that are dropped and counted in the progress of the query. Operators marked
*batch* need earlier windows as rows and run on the finished windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import LATENCY_BOUNDS


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def windowed(
    events: DataFrame, aggregates: dict[str, Column], by: Sequence[str] = (), width: str = "5 minutes",
    slide: str | None = None, late: str | None = None,
) -> DataFrame:
    """Aggregates per event-time window and group: window_start, window_end, by…, aggregates."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        _watermarked(events, late)
        .groupBy(window.alias("_w"), *by)
        .agg(*[column.alias(name) for name, column in aggregates.items()])
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggregates)
    )


def request_rates(events: DataFrame, width: str = "5 minutes", late: str | None = None) -> DataFrame:
    return windowed(events, {"n_requests": F.count(F.lit(1))}, ["endpoint", "method", "status"], width, late=late)


def sliding_rate(events: DataFrame, width: str = "5 minutes", slide: str = "30 seconds", by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """Requests per second over a sliding window."""
    counts = windowed(events, {"n_requests": F.count(F.lit(1))}, by, width, slide, late)
    seconds = F.unix_timestamp("window_end") - F.unix_timestamp("window_start")
    return counts.withColumn("rate", F.col("n_requests") / seconds)


def latency_histogram(
    events: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS, value: str = "seconds", by: Sequence[str] = ("endpoint",),
    width: str | None = None, late: str | None = None,
) -> DataFrame:
    """Cumulative bucket counts, the last bucket being infinite: by…, le, n.

    All buckets are counted in one aggregation and only then turned into rows.
    """
    counters = {f"_le{i}": F.count_if(F.col(value) <= b) for i, b in enumerate(bounds)}
    counters[f"_le{len(bounds)}"] = F.count(value)
    if width:
        counted, keys = windowed(events, counters, by, width, late=late), ["window_start", "window_end", *by]
    else:
        counted, keys = events.groupBy(*by).agg(*[c.alias(n) for n, c in counters.items()]), list(by)
    buckets = F.array(
        *[F.struct(F.lit(float(le)).alias("le"), F.col(f"_le{i}").alias("n")) for i, le in enumerate([*bounds, float("inf")])]
    )
    return counted.select(*keys, F.inline(buckets))


def bucket_quantile(histogram: DataFrame, q: float, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Quantile by linear interpolation within the bucket that holds it.

    The first bucket starts at 0; a quantile in the infinite bucket is its lower bound. No data, no value.
    """
    ordered = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rows = histogram.withColumns(
        {
            "_below": F.coalesce(F.lag("n").over(ordered), F.lit(0)),
            "_low": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)),
            "_rank": F.max("n").over(whole) * F.lit(q),
        }
    )
    holds = (F.col("n") >= F.col("_rank")) & (F.col("n") > 0)
    inside = F.try_divide(F.col("_rank") - F.col("_below"), F.col("n") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(
        F.col("_low") + (F.col("le") - F.col("_low")) * F.coalesce(inside, F.lit(1.0))
    )
    return rows.groupBy(*by).agg(F.min_by(F.when(holds, value), F.when(holds, F.col("le"))).alias("value"))


def error_ratio(events: DataFrame, width: str = "5 minutes", threshold: float = 0.01, late: str | None = None) -> DataFrame:
    counts = windowed(
        events, {"n_errors": F.count_if(F.col("status") >= 500), "n_requests": F.count(F.lit(1))}, (), width, late=late
    )
    ratio = F.try_divide(F.col("n_errors"), F.col("n_requests"))
    return counts.withColumn("ratio", ratio).withColumn("firing", F.col("ratio") > threshold)


def label_ratio(
    events: DataFrame, label: str, value: str, threshold: float, below: bool = False, width: str = "5 minutes", late: str | None = None
) -> DataFrame:
    """Share of one label value, firing above (or, with ``below``, under) the threshold."""
    counts = windowed(
        events, {"n_matching": F.count_if(F.col(label) == value), "n_labelled": F.count(label)}, (), width, late=late
    )
    ratio = F.try_divide(F.col("n_matching"), F.col("n_labelled"))
    fires = F.col("ratio") < threshold if below else F.col("ratio") > threshold
    return counts.withColumn("ratio", ratio).withColumn("firing", fires)


def rate_drop(rates: DataFrame, back: str = "1 hour", threshold: float = 0.5, value: str = "n_requests", until: Column | None = None) -> DataFrame:
    """*batch* Each window that has one ``back`` earlier, against that one; a window without events counts 0.

    Without events at all after some time there is a row for each of those windows up to ``until`` (a window's start;
    by default that of the last window with events), so a complete stop fires as well.
    """
    shift = F.expr(f"interval {back}")
    end = F.lit(until) if until is not None else rates.agg(F.max("window_start")).scalar()
    before = rates.select(
        (F.col("window_start") + shift).alias("window_start"), (F.col("window_end") + shift).alias("window_end"), F.col(value).alias("before")
    ).where(F.col("window_start") <= end)
    return (
        before.join(rates.drop("window_end"), "window_start", "left")
        .withColumn(value, F.coalesce(F.col(value), F.lit(0)))
        .withColumn("ratio", F.try_divide(F.col(value), F.col("before")))
        .withColumn("firing", F.col("ratio") < threshold)
    )


def rate_drop_stream(events: DataFrame, back: str = "1 hour", width: str = "5 minutes", threshold: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: two window aggregates joined on their window time.

    The earlier side is shifted forward, so both sides carry the time at which they are compared. A window that
    has an earlier one but no events comes out with 0 once the watermark has passed it.
    """
    now = _watermarked(events, late).groupBy(F.window("ts", width).alias("window")).agg(F.count(F.lit(1)).alias("n_requests"))
    shifted = events.withColumn("ts", F.col("ts") + F.expr(f"interval {back}"))
    past = _watermarked(shifted, late).groupBy(F.window("ts", width).alias("window")).agg(F.count(F.lit(1)).alias("before"))
    a = now.select(F.window_time("window").alias("at"), F.col("window.start").alias("window_start"), "n_requests")
    b = past.select(F.window_time("window").alias("at_b"), F.col("window.start").alias("start_b"), "before")
    return (
        b.join(a, F.col("at") == F.col("at_b"), "left")
        .select(F.col("start_b").alias("window_start"), F.coalesce("n_requests", F.lit(0)).alias("n_requests"), "before")
        .select("window_start", "n_requests", "before", F.try_divide(F.col("n_requests"), F.col("before")).alias("ratio"))
        .withColumn("firing", F.col("ratio") < threshold)
    )


def absent_windows(events: DataFrame, minutes: int = 2, until: Column | None = None) -> DataFrame:
    """*batch* Windows from the first event on that hold none, up to the last event or to ``until`` (a time) if that is later.

    With ``until`` set to now, a service that has been silent up to now is seen. The spine is built in two steps, days and
    then windows of a day, dealt out by day in between, so it spreads over tasks. ``minutes`` divides a day.
    """
    start = F.window("ts", f"{minutes} minutes")["start"]
    seen = events.select(start.alias("window_start")).groupBy("window_start").agg(F.count(F.lit(1)).alias("n_requests"))
    last = F.max("window_start") if until is None else F.greatest(F.max("window_start"), until - F.make_dt_interval(mins=F.lit(minutes)))
    span = seen.agg(F.min("window_start").alias("lo"), last.alias("hi"))
    days = span.select("lo", "hi", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day")).repartition("day")
    minute = F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - minutes), F.lit(minutes)))
    spine = days.select("lo", "hi", "day", minute.alias("m")).select(
        "lo", "hi", (F.col("day").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("window_start")
    ).where((F.col("window_start") >= F.col("lo")) & (F.col("window_start") <= F.col("hi")))
    return spine.select("window_start").join(seen, "window_start", "left_anti").withColumn("n_requests", F.lit(0))


def sustained(alerts: DataFrame, n: int, width_minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """*batch* Runs of at least n consecutive firing windows: by…, run_start, run_end, n_windows.

    Consecutive windows share the difference between their index in time and their rank. There is one
    row per window and group, so a group is bounded by the windows of the time range.
    """
    index = F.floor(F.unix_timestamp("window_start") / (width_minutes * 60))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("window_start"))
    firing = alerts.where(F.col("firing")).withColumn("_island", index - rank)
    return (
        firing.groupBy(*by, "_island")
        .agg(F.min("window_start").alias("run_start"), F.max("window_end").alias("run_end"), F.count(F.lit(1)).alias("n_windows"))
        .where(F.col("n_windows") >= n)
        .drop("_island")
    )


def threshold_alerts(metrics: DataFrame, thresholds: dict[str, float], metric: str = "metric", value: str = "value") -> DataFrame:
    """Windows in which a metric exceeds its threshold. Thresholds are a literal map, not a join."""
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    limit = F.try_element_at(limits, F.col(metric))
    return metrics.withColumn("threshold", limit.cast("double")).withColumn("firing", F.col(value) > F.col("threshold")).where(
        F.col("threshold").isNotNull()
    )


def dedupe_requests(events: DataFrame, keys: Sequence[str], ttl: str = "1 hour") -> DataFrame:
    """Collapse repeated requests.

    On a stream: the first within the watermark delay, a lower bound on what is dropped. On a batch: the
    first per key and clock window of the TTL, as an aggregate with map-side combine.
    """
    if events.isStreaming:
        return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("ts", "event_id"))
    return (
        events.groupBy(*keys, F.window("ts", ttl).alias("_w")).agg(first.alias("_r")).select(*keys, "_r.*").select(*events.columns)
    )
