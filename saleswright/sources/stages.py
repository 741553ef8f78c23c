"""Stage tables: Parquet between the steps of a job, and versioned snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns the path (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Overwrite a stage. With partition columns, rows are rebalanced on them first, so each value gets
    files of even size: large values are split over several tasks and small ones share one."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def read_features(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"feature matrix not found at {path}; write it with write_stage first")
    return spark.read.parquet(path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts its lineage, survives lost executors."""
    return df.sparkSession.read.parquet(write_stage(df, scratch_dir(df.sparkSession, name)))


_STAGED: dict[tuple[str, ...], str] = {}


def staged(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """Build a table once per application, keep it in the shared scratch folder, and read it back.

    Downstream frames use such a table several times (calendar, latest date, series). Reading a written
    table avoids repeating the joins behind it, cuts the lineage and survives lost executors.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STAGED:
        _STAGED[full] = write_stage(build(), scratch_dir(spark, key[0]))
    return spark.read.parquet(_STAGED[full])


def snapshot_metadata(df: DataFrame, version: Column | str, date: str = "date") -> DataFrame:
    """Row count, date range and version of a feature snapshot."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(date).alias("data_date_min"),
        F.max(date).alias("data_date_max"),
    ).withColumn("version", F.lit(version))


def publish_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a snapshot under its own version folder; readers move over by :func:`refresh_snapshot`."""
    return write_stage(df, f"{root.rstrip('/')}/version={version}")


def _version_order(version: str) -> list:
    """Runs of digits count as numbers: v9 comes before v10."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", version) if x]


def refresh_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Read the newest version below ``root``, dropping what Spark remembers about its files.

    The newest is found by listing the version folders; only that folder is read.
    """
    spark.catalog.refreshByPath(root)
    versions = []
    if path_exists(spark, root):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        names = [x.getPath().getName() for x in listed]
        versions = [n.removeprefix("version=") for n in names if n.startswith("version=")]
    if not versions:
        raise FileNotFoundError(f"no snapshot below {root}")
    newest = max(versions, key=_version_order)
    return spark.read.parquet(f"{root.rstrip('/')}/version={newest}").withColumn("version", F.lit(newest))


def snapshot_health(
    meta: DataFrame, now: Column, loaded_at: Column, threshold_hours: int = 24
) -> DataFrame:
    """Age of the snapshot and of its newest data, and healthy / stale / not loaded."""
    age_hours = F.timestamp_diff("HOUR", loaded_at, now)
    loaded = F.col("row_count") > 0
    # Whole hours must not hide minutes past the threshold: compare the instants themselves.
    fresh = loaded & (now < loaded_at + F.make_dt_interval(hours=F.lit(threshold_hours)))
    return meta.select(
        "*",
        loaded.alias("loaded"),
        F.coalesce(fresh, F.lit(False)).alias("fresh"),
        F.when(loaded, age_hours).alias("age_hours"),
        F.when(loaded, F.timestamp_diff("HOUR", F.col("data_date_max").cast("timestamp"), now)).alias("data_age_hours"),
        F.when(~loaded, "not loaded").when(fresh, "healthy").otherwise("stale").alias("status"),
    )
