"""Shared pieces: whole tables, words, prefix sums, and connected components that never leave the executors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.stages import materialised

WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that only the seed and the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def running_totals(counts: DataFrame, at: str, n: str, out: str, *by: str, width: int = 4096) -> DataFrame:
    """Adds to each row (``at`` counts from 0, one row each) the sum of ``n`` of the rows before it.

    Two levels, so that no task sees more than ``width`` rows or one row for each ``width``.
    """
    block = counts.withColumn("_block", F.floor(F.col(at) / width))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = block.groupBy(*by, "_block").agg(F.sum(n).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        block.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(heads, [*by, "_block"])
        .withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in", "_block")
    )


def bucketed(df: DataFrame, name: str, key: str, total_bytes: int, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``df`` as a written table bucketed by ``key``: joins and groups on the key then do not move its rows.

    The files lie in the shared scratch folder; the table's name lasts as long as the session's catalog.
    """
    spark = df.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-total_bytes // bucket_bytes))
    full = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", scratch_dir(spark, full)).bucketBy(buckets, key).saveAsTable(full)
    return spark.table(full)


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (id, root) of every linked node.

    Alternates the large-star and the small-star step until the links are stars around the smallest node.
    Each half-step takes a minimum per node (combined before the shuffle) and joins it back; both sides of
    that join are written tables, so the plan reads them through plain exchanges and AQE can split the node
    that many links meet in. Written tables also cut the lineage.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialised(links, "links")
    seen = _digest(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialised(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low")), "lowest")
        large = both.join(low, "a").where("b > a and b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        links = materialised(large, "links")
        low = materialised(links.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        small = links.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = materialised(small.unionByName(low.withColumnRenamed("low", "b")).distinct(), "links")
        now = _digest(links)
        if now == seen:
            break
        seen = now
    members = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _digest(links: DataFrame) -> tuple:
    """Equal for equal sets of links: number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.bitwiseAND(0xFFFFFFFF)), F.lit(0)),
                           F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0))).first())


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id long, unique; value long) with ``component``: the smallest value in the node's component."""
    members = materialised(nodes.join(components(edges), "id"), "members")
    lowest = materialised(members.groupBy("root").agg(F.min("value").alias("component")), "lowest")
    found = materialised(members.join(lowest, "root").select("id", "component"), "found")
    return nodes.join(found, "id", "left").withColumn("component", F.coalesce("component", "value"))


#: For SQL twins: a table of one row, crc, with what the CRC-32 of each byte does; and the checksum of ASCII text.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""
