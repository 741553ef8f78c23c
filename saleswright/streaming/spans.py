"""Repeated requests under an exact lifetime: a request that is let through absorbs its repeats for a time, then the next one is.

The span begins with the request that was let through, not with the clock. So whether a request passes depends on the
whole chain before it: by spans joined two by two over a batch, by a state on a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import materialised
from .states import _kinds, _Timed


def first_of_spans(events: DataFrame, keys: Sequence[str], ttl_seconds: int = 3600) -> DataFrame:
    """*batch* The events that are let through: the first of a key, then each time the first one ``ttl_seconds`` or more later.

    Ties of time go by event_id. Every event points at the one that would follow it. Events are cut by key and
    clock span, so a busy key is many groups: the follower is in the next span, or else the first of a later one. The
    chain from the first event of each key takes one event of a span at most. Spans are joined two by two, and of each table
    only the events that are pointed at from an earlier one of the joined spans stay, so tables halve; on the way back the
    chain is filled in. Null times are left out; null keys are a key.
    """
    ttl = ttl_seconds * 1_000_000
    rows = events.where(F.col("ts").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    rows = materialised(rows, "requests")
    links = materialised(_followers(rows, keys, ttl), "links")
    levels = []
    while links.where("upto >> 1 <> block >> 1").limit(1).count():
        levels.append(links)
        links = materialised(_joined(links), "links")
    kept = links.where("head").select("row")
    # All pointers are inside one pair of spans now; then those of the next smaller pairs, and so on.
    for links in [links, *reversed(levels)]:
        inside = links.where("next is not null and upto >> 1 = block >> 1").join(kept, "row", "left_semi")
        kept = materialised(kept.unionByName(inside.select(F.col("next").alias("row"))), "kept")
    return rows.join(kept.select(F.col("row").alias("_row")), "_row", "left_semi").drop("_row")


def _followers(rows: DataFrame, keys: Sequence[str], ttl: int) -> DataFrame:
    """row, block, next, upto, head: every event with its follower, the numbers of their spans among those of the key that have events, and whether it is its key's first."""
    brief = rows.select(F.struct(*keys).alias("k"), F.unix_micros("ts").alias("us"), F.struct(F.unix_micros("ts").alias("us"), "event_id", "_row").alias("me"))
    brief = brief.withColumn("span", F.floor(F.col("us") / ttl))
    offset = F.pmod("us", F.lit(ttl))
    none = F.lit(None).cast(brief.schema["me"].dataType)
    asked = brief.select("k", (F.col("span") + 1).alias("span"), offset.alias("o"), F.lit(0).alias("kind"), none.alias("me"), F.col("me").alias("of"))
    there = brief.select("k", "span", offset.alias("o"), F.lit(1).alias("kind"), "me", none.alias("of"))
    # From the last one on: a frame that only grows costs a step a row, one that shrinks is summed up anew for each.
    onward = Window.partitionBy("k", "span").orderBy(F.desc("o"), F.desc("kind"), F.desc("me"))
    near = asked.unionByName(there).withColumn("near", F.last("me", ignorenulls=True).over(onward.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 0")
    spans = Window.partitionBy("k").orderBy("span")
    firsts = brief.groupBy("k", "span").agg(F.min("me").alias("first")).select(
        F.col("k").alias("_k"), (F.col("span") + 1).alias("_s"), F.row_number().over(spans).alias("block"), "first",
        *[F.lead(c, n).over(spans).alias(f"{c}{n}") for c in ("span", "first") for n in (1, 2)])
    # The first event of a span after the next one, and how many spans with events that is further on.
    adjacent = F.col("span1") == F.col("_s")
    beyond = firsts.select("_k", "_s", "block", F.col("first._row").alias("lead"), F.when(adjacent, F.col("first2")).otherwise(F.col("first1")).alias("beyond"),
                           F.when(adjacent, 2).otherwise(1).alias("further"))
    found = near.join(beyond, F.col("k").eqNullSafe(F.col("_k")) & (F.col("span") == F.col("_s")))
    upto = F.when(F.col("near").isNotNull(), F.col("block") + 1).when(F.col("beyond").isNotNull(), F.col("block") + F.col("further"))
    row = F.col("of._row")
    return found.select(row.alias("row"), "block", F.coalesce("near", "beyond")["_row"].alias("next"), upto.alias("upto"), ((F.col("block") == 1) & (row == F.col("lead"))).alias("head"))


def _joined(links: DataFrame) -> DataFrame:
    """The same over spans twice as wide: heads, and the events that are pointed at from an earlier one of these."""
    inside = F.shiftright("upto", 1) == F.shiftright("block", 1)
    entered = links.where("upto >> 1 <> block >> 1").select(F.col("next").alias("row")).distinct()
    stay = links.where("head").unionByName(links.where("not head").join(entered, "row", "left_semi"))
    onward = links.select(F.col("row").alias("_at"), F.col("next").alias("_next"), F.col("upto").alias("_upto"))
    crossing = stay.where(F.coalesce(~inside, F.lit(True)))
    passing = stay.where(inside).join(onward, F.col("next") == F.col("_at")).select("row", "block", F.col("_next").alias("next"), F.col("_upto").alias("upto"), "head")
    return crossing.unionByName(passing).withColumns({c: F.shiftright(c, 1) for c in ("block", "upto")})


class Spans(_Timed):
    """a: the time of the last request let through, in microseconds; b is 1 if there is one. The timer forgets it when its span has run out."""

    def __init__(self, by: Sequence[str], ttl: int) -> None:
        super().__init__(by, 0)
        self.ttl = ttl

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        a, b, timer = self.load()
        us, event = (np.concatenate(x) for x in zip(*((np.array(f["us"]), np.array(f["event_id"])) for f in rows)))
        order = np.argsort(us)
        us, event = us[order], event[order]
        found = []
        at = int(np.searchsorted(us, a + self.ttl)) if b else 0
        while at < len(us):
            a = int(us[at])
            found.append((a, int(event[at])))
            at = int(np.searchsorted(us, a + self.ttl))
        if found:
            self.save(a, 1, math.ceil((a + self.ttl) / 1000), timer)
        yield from self.frame(key, found, ["us", "event_id"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, timer = self.load()
        if timer and expiredTimerInfo.getExpiryTimeInMs() == timer:
            self.value.clear()
        return iter(())


def first_of_spans_stream(events: DataFrame, keys: Sequence[str], ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: keys…, ts, event_id of the events let through, each once the watermark has passed it.

    Events wait for the watermark in an aggregation by key and time, spread over all tasks, so they are taken in the order of
    their times however they arrive. What a batch's watermark has passed of a key then goes through the task that holds its state,
    as two numbers an event. A key without requests for a span is forgotten.
    """
    due = events.withWatermark("ts", late).where(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.min("event_id").alias("event_id"))
    brief = due.select(*keys, "ts", F.unix_micros("ts").alias("us"), "event_id")
    found = brief.groupBy(*keys).transformWithStateInPandas(Spans(keys, ttl_seconds * 1_000_000), f"{_kinds(brief, keys)}us long, event_id long", "append", "EventTime")
    return found.select(*keys, F.timestamp_micros("us").alias("ts"), "event_id")
