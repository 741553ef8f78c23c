"""Run a streaming aggregate over files to its end, into a Parquet table of the shared folder."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import scratch_dir
from ..sources.stages import path_exists


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the raw events table of a data folder."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(
    stream: DataFrame, name: str, mode: str = "append", out: str | None = None, settings: dict[str, str] | None = None
) -> tuple[DataFrame, list[dict]]:
    """Process all available input; return the written table and the progress reports.

    With the ``out`` folder of an earlier run, go on from where that one stopped, watermark included. The reports
    come from a listener: the query itself keeps the latest only. ``settings`` hold for this query.
    """
    spark = stream.sparkSession
    heard = _Progress()
    spark.streams.addListener(heard)
    out = out or scratch_dir(spark, name)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    for k, v in before.items():  # a query keeps the settings that it was started with
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    heard.ended.wait(60)
    spark.streams.removeListener(heard)
    return spark.read.schema(stream.schema).parquet(f"{out}/data"), heard.reports.get(str(query.runId), [])


class _Progress(StreamingQueryListener):
    """All progress reports, by run."""

    def __init__(self) -> None:
        self.reports: dict[str, list[dict]] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.reports.setdefault(str(event.progress.runId), []).append(json.loads(event.progress.json))

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def dropped_by_watermark(progress: list[dict]) -> int:
    """Rows of the state operators, partly aggregated, that came after the watermark had passed their window, over all batches."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))


def next_watermark(spark: SparkSession, out: str) -> int:
    """The watermark, in milliseconds, that the next batch of a drained stream starts with: as its commits say; 0 before the first."""
    commits = f"{out}/checkpoint/commits"
    if not path_exists(spark, commits):
        return 0
    found = spark.read.text(commits).select(F.get_json_object("value", "$.nextBatchWatermarkMs").cast("long").alias("ms"))
    return max(0, found.agg(F.max("ms")).first()[0] or 0)


LATENESS = "lateness"


def drain_counted(events: DataFrame, aggregate: Callable[[DataFrame], DataFrame], width: str, name: str, out: str | None = None) -> tuple[DataFrame, str, dict]:
    """Drain a windowed aggregate of a stream and count its events: the table, its folder, and n_events, n_late, n_kept.

    An observation ahead of the aggregation compares every event with the watermark that the run starts with: an event is late if
    its window of ``width`` is over by then. It counts events, not the partly aggregated rows that the state operator
    drops. The source is to be read in one batch a run, as it is without a limit of files, since within a run of
    several batches the watermark would go on. Call again with ``out`` for what has arrived since.
    """
    spark = events.sparkSession
    out = out or scratch_dir(spark, name)
    over = F.lit(next_watermark(spark, out))
    late = F.unix_millis(F.window("ts", width)["end"]) <= over
    observed = events.withColumn("_late", late).observe(LATENESS, F.count(F.lit(1)).alias("n_events"), F.count_if("_late").alias("n_late")).drop("_late")
    table, progress = drain(aggregate(observed), name, out=out)
    batches = [p["observedMetrics"][LATENESS] for p in progress if p.get("numInputRows") and LATENESS in p.get("observedMetrics", {})]
    if len(batches) > 1:
        raise ValueError("the source was read in several batches; their watermarks differ")
    n_events, n_late = (int(batches[0][c]) for c in ("n_events", "n_late")) if batches else (0, 0)
    return table, out, {"n_events": n_events, "n_late": n_late, "n_kept": n_events - n_late}
