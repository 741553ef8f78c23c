"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import free_name, running_totals, table

BUCKET_BYTES = 4 << 20
#: Offsets of so many buckets (16 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def external_shuffle(
    df: DataFrame, shards: int = 8, seed: int = 11, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    First pass: a seeded hash scatters the rows uniformly into so many buckets that one holds about
    ``bucket_bytes``. Second pass: each bucket, read into one array, is permuted by Fisher-Yates (``shuffle``) and written.
    The buckets one after the other are a random order of all rows; its positions are dealt to the shards in
    turn, so shard sizes differ by one row at most. Bucket starts are sums over bucket counts, in two levels.

    The hash covers the key and the row's place in the scan, so equal rows, or one key in a third of all rows,
    spread as evenly as others; a rerun over the same files and splits gives the same order, also after the
    loss of an executor. All columns are kept, null or not; columns called shard or slot are replaced.
    A text longer than a bucket has a larger array to itself. No rows give no rows.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    place = free_name(df, "_place")
    numbered = df.select(*kept).withColumn(place, F.monotonically_increasing_id())
    row = F.struct(*[numbered[c] for c in kept])
    total = df.agg(F.coalesce(F.sum(text_bytes(df[text])), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    width = max(df.sparkSession.sparkContext.defaultParallelism, -(-buckets // 4))
    scattered = numbered.select(
        row.alias("row"),
        F.pmod(F.xxhash64(F.lit(seed), key, place), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed + 1), key, place).alias("draw"), F.col(place).alias("place"))
    # An explicit width is kept by AQE: which buckets a task gets, and their order, are the same in each run.
    ordered = scattered.repartition(width, "bucket").sortWithinPartitions("bucket", "draw", "place")
    shuffled = ordered.groupBy("bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows"))
    written = materialised(shuffled.select("bucket", F.posexplode("rows").alias("pos", "row")), "shuffled")
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = materialised(running_totals(counts, "bucket", "n", "start").select("bucket", "start"), "starts")
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    position = F.col("start") + F.col("pos")
    return written.join(starts, "bucket").select(
        "row.*", F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.floor(position / F.lit(shards)).alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> str:
    """Writes the shards as folders ``shard=…``, each a series of files in slot order."""
    run = free_name(sharded, "_run")
    (
        sharded.withColumn(run, F.floor(F.col("slot") / rows_per_file)).repartition("shard", run)
        .sortWithinPartitions("shard", "slot").drop(run).write.mode("overwrite").partitionBy("shard").parquet(path)
    )
    return path


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return external_shuffle(docs).select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
