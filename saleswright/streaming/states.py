"""Operators that keep a state per group of a stream and act on event-time timers: sustained alerts and silence.

They read finished windows (an append-mode aggregation), one row a window and group, so a busy group costs its
windows only. What they give out depends on the windows and the watermark alone, never on how the events were cut
into micro-batches; the batch forms beside them give the same rows for a given last watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from .slo import _watermarked

#: State needs a store with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FIRING, RESOLVED = "firing", "resolved"


class _Timed(StatefulProcessor):
    """One value (three longs) and at most one timer a group. Times are milliseconds."""

    def __init__(self, by: Sequence[str], width: int) -> None:
        self.by, self.width = list(by), width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "a long, b long, timer long")

    def close(self) -> None:
        pass

    def load(self) -> tuple[int, int, int]:
        return tuple(self.value.get()) if self.value.exists() else (0, 0, 0)

    def save(self, a: int, b: int, timer: int, before: int) -> None:
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            if timer:
                self.handle.registerTimer(timer)
        self.value.update((a, b, timer))

    def frame(self, key: tuple, rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=names)
            for place, (name, value) in enumerate(zip(self.by, key)):
                frame.insert(place, name, value)
            yield frame


def _windows(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("start_ms")


class Sustained(_Timed):
    """A run of firing windows; a and b are its first start and last end, 0 for none."""

    NAMES = ["start_ms", "at_ms", "state", "n_windows"]

    def __init__(self, by: Sequence[str], width: int, n: int) -> None:
        super().__init__(by, width)
        self.n = n

    def over(self, start: int, end: int) -> list[tuple]:
        length = (end - start) // self.width
        return [(start, end, RESOLVED, length)] if start < end and length >= self.n else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, timer = self.load()
        found = []
        windows = _windows(rows)
        for at, firing in zip(windows["start_ms"].tolist(), windows["firing"].tolist()):
            if not firing or at != end:
                found += self.over(start, end)
                start = end = 0
            if firing:
                start = start if end else at
                end = at + self.width
                if end - start == self.n * self.width:
                    found.append((start, end, FIRING, self.n))
        # If the next window has no row, nothing but the watermark tells that the run is over.
        self.save(start, end, end + self.width if self.over(start, end) else 0, timer)
        yield from self.frame(key, found, self.NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end, timer = self.load()
        if timer and expiredTimerInfo.getExpiryTimeInMs() == timer:
            self.value.clear()
            yield from self.frame(key, self.over(start, end), self.NAMES)


class Silence(_Timed):
    """Windows without events since the first; a is the end of the last window known to be over."""

    NAMES = ["start_ms"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end, _, timer = self.load()
        found = []
        for at in _windows(rows)["start_ms"].tolist():
            found += [(x,) for x in range(end, at, self.width)] if end else []
            end = at + self.width
        self.save(end, 0, end + self.width, timer)
        yield from self.frame(key, found, self.NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, _, timer = self.load()
        if timer and expiredTimerInfo.getExpiryTimeInMs() == timer:
            upto = timerValues.getCurrentWatermarkInMs()
            over = range(end, upto - self.width + 1, self.width)
            end = over.stop if not len(over) else over[-1] + self.width
            # The timer itself has gone off; the next one waits for the next window to be over.
            self.handle.registerTimer(end + self.width)
            self.value.update((end, 0, end + self.width))
            yield from self.frame(key, [(x,) for x in over], self.NAMES)


def _stamp(ms: str) -> Column:
    return F.timestamp_millis(ms)


def _keyed(windows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Without groups, all windows are one: a few rows an hour."""
    return (windows, list(by)) if by else (windows.withColumn("_all", F.lit(0)), ["_all"])


def _kinds(windows: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {windows.schema[c].dataType.simpleString()}, " for c in by)


def sustained_stream(
    events: DataFrame, firing: Column, aggregates: dict[str, Column], n: int, width_minutes: int, by: Sequence[str] = (), late: str = "10 minutes"
) -> DataFrame:
    """Alerts that hold for n windows in a row: by…, run_start, at, state, n_windows.

    ``firing`` is a condition on the aggregates of a window. A row with state ``firing`` comes when the run has lasted n
    windows, one with ``resolved`` when it is over: a window that does not fire, or none, which the watermark tells.
    """
    width = width_minutes * 60_000
    windows = _watermarked(events, late).groupBy(F.window("ts", f"{width_minutes} minutes").alias("window"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    told = windows.select(*by, F.window_time("window").alias("window_at"), F.unix_millis("window.start").alias("start_ms"), F.coalesce(firing, F.lit(False)).alias("firing"))
    told, keys = _keyed(told, by)
    found = told.groupBy(*keys).transformWithStateInPandas(
        Sustained(keys, width, n), f"{_kinds(told, keys)}start_ms long, at_ms long, state string, n_windows long", "append", "EventTime")
    return found.select(*by, _stamp("start_ms").alias("run_start"), _stamp("at_ms").alias("at"), "state", "n_windows")


def sustained_rows(alerts: DataFrame, n: int, width_minutes: int, until: Column, by: Sequence[str] = ()) -> DataFrame:
    """*batch* The same rows from window rows (window_start, firing), as of the watermark ``until``.

    There is one row a window and group, so a group is bounded by the windows of the time range.
    """
    width = F.make_dt_interval(mins=F.lit(width_minutes))
    closed = alerts.where(F.col("firing") & (F.col("window_start") + width <= until))
    index = F.floor(F.unix_timestamp("window_start") / (width_minutes * 60))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("window_start"))
    runs = closed.withColumn("_island", index - rank).groupBy(*by, "_island").agg(F.min("window_start").alias("run_start"), F.count(F.lit(1)).alias("n_windows")).where(F.col("n_windows") >= n)
    after = lambda windows: F.col("run_start") + F.make_dt_interval(mins=windows * width_minutes)
    first = runs.select(*by, "run_start", after(F.lit(n)).alias("at"), F.lit(FIRING).alias("state"), F.lit(n).cast("long").alias("n_windows"))
    last = runs.select(*by, "run_start", after(F.col("n_windows").cast("int")).alias("at"), F.lit(RESOLVED).alias("state"), "n_windows")
    return first.unionByName(last.where(F.col("at") + width <= until))


def silence_stream(events: DataFrame, minutes: int = 2, by: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Windows without events of a group, from its first on: by…, window_start, each once the watermark has passed it.

    A group that falls silent is reported for as long as others, or later events of its own, move the watermark.
    """
    windows = _watermarked(events, late).groupBy(F.window("ts", f"{minutes} minutes").alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
    told, keys = _keyed(windows.select(*by, F.window_time("window").alias("window_at"), F.unix_millis("window.start").alias("start_ms")), by)
    found = told.groupBy(*keys).transformWithStateInPandas(Silence(keys, minutes * 60_000), f"{_kinds(told, keys)}start_ms long", "append", "EventTime")
    return found.select(*by, _stamp("start_ms").alias("window_start"))


def silence_rows(events: DataFrame, minutes: int, until: Column, by: Sequence[str] = ()) -> DataFrame:
    """*batch* The same rows as of the watermark ``until``: the gaps between a group's windows, and the last one up to ``until``."""
    width = minutes * 60
    start = F.floor(F.unix_timestamp("ts") / width) * width
    end = F.unix_timestamp(until)
    seen = events.select(*by, start.alias("s")).distinct().where(F.col("s") + width <= end)
    following = F.lead("s").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("s"))
    stop = F.coalesce(following, F.floor(end / width) * width)
    gaps = seen.withColumn("_stop", stop).where(F.col("_stop") > F.col("s") + width)
    each = F.explode(F.sequence(F.col("s") + width, F.col("_stop") - width, F.lit(width).cast("long")))
    return gaps.select(*by, each.alias("_at")).select(*by, F.timestamp_seconds("_at").alias("window_start"))
