"""Rows of sequences in one global order, cut into parts of even size whatever the sequences' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import materialised

#: Rows of a part, about; parts come from Spark's sampled ranges.
PART_ROWS = 65_536


def turn_order(conv: str, turn: str, role: str, text: str) -> list[Column]:
    """The order of turns: by turn, nulls first; ties by role, the text's first 64 characters, and its hash."""
    return [F.col(conv).asc(), F.col(turn).asc(), F.col(role).asc(), F.substring(text, 1, 64).asc(), F.xxhash64(text).asc()]


def in_order(rows: DataFrame, by: list[Column], keep: list[str], name: str, part_rows: int | None = None) -> DataFrame:
    """``rows`` sorted over all partitions and written, with ``place`` (rising in that order) and ``part``.

    Parts are ranges of the whole order, so a long sequence is spread over several, and a place tells where a
    row stands without any group being gathered. Rows that agree in all of ``by`` are spread as well.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // (part_rows or PART_ROWS)))
    dealt = rows.withColumn("_any", F.monotonically_increasing_id())
    by = [*by, F.col("_any").asc()]
    placed = dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("place"))
    return materialised(placed.withColumn("part", F.shiftright("place", 33)), name)
