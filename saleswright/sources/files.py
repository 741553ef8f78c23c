"""CSV and JSON readers and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell
from .stages import path_exists

SALES_SCHEMA = "date STRING, store_nbr INT, family STRING, sales DOUBLE, onpromotion BIGINT"

EXTERNAL_SCHEMAS = {
    "oil": "date STRING, dcoilwtico DOUBLE",
    "holidays": "date STRING, type STRING, locale STRING",
    "stores": "store_nbr INT, city STRING, type STRING, cluster INT",
    "transactions": "date STRING, store_nbr INT, transactions BIGINT",
}
EXTERNAL_FILES = {"holidays": "holidays_events"}

REQUEST_COLUMNS = ("store_nbr", "family", "date", "horizon")
FORECAST_COLUMNS = ("actual", "forecast", "lower_80", "upper_80", "lower_95", "upper_95")
BAND_COLUMNS = ("prediction", "lower_80", "upper_80", "lower_95", "upper_95")


def iso_date(col: str) -> Column:
    return F.to_date(col, "yyyy-MM-dd")


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with header, columns matched by name: the file may hold more columns or another order.

    A required column that is missing is an error; others may be absent.
    """
    wanted = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing required columns: {', '.join(missing)}")
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in wanted if f.name in raw.columns])


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The fact: day, store, family and sales must be there; the promotion count may be absent."""
    return read_csv(spark, path, SALES_SCHEMA, ("date", "store_nbr", "family", "sales")).withColumn("date", iso_date("date"))


def read_external(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Whichever side tables are present; a missing file is skipped."""
    found = {}
    for name, schema in EXTERNAL_SCHEMAS.items():
        path = f"{folder.rstrip('/')}/{EXTERNAL_FILES.get(name, name)}.csv"
        if path_exists(spark, path):
            df = read_csv(spark, path, schema)
            found[name] = df.withColumn("date", iso_date("date")) if "date" in df.columns else df
    return found


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object per line; nested trees and waterfalls keep their shape."""
    df.write.mode("overwrite").json(path)
    return path


def read_metrics(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_importance(df: DataFrame, path: str) -> str:
    """Feature importances, best first. There is one row per feature."""
    return write_csv(df.select("feature", "importance").orderBy(F.desc("importance"), "feature"), path)


def forecast_export(df: DataFrame) -> DataFrame:
    """Text columns of the forecast export: two decimals, empty for null."""
    return df.select(F.col("date").cast("string").alias("date"), *[cell(F.col(c)).alias(c) for c in FORECAST_COLUMNS])


def export_forecast(df: DataFrame, path: str) -> str:
    return write_csv(forecast_export(df), path)


def batch_export(df: DataFrame) -> DataFrame:
    """The nine result columns of the rows that succeeded."""
    return df.where(F.col("status") == "success").select(
        "store_nbr", "family", F.col("date").cast("string").alias("date"), "horizon",
        *[cell(F.col(c)).alias(c) for c in BAND_COLUMNS],
    )


def write_batch_results(df: DataFrame, path: str) -> str:
    return write_csv(batch_export(df), path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests: header in any case or order, further columns ignored, blank lines skipped.

    Quoted families may hold commas. Numbers that cannot be read become null and are judged by the
    validation. ``row_id`` is the number of the data row, from 1, over all files in order of their paths.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    by_name = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in REQUEST_COLUMNS if c not in by_name]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")

    def text(name: str) -> Column:
        return F.trim(F.col(f"`{by_name[name]}`"))

    def number(name: str) -> Column:
        return F.regexp_extract(text(name), r"^([+-]?\d+)", 1).try_cast("int")

    return numbered_rows(raw).select(
        "row_id",
        number("store_nbr").alias("store_nbr"),
        F.upper(text("family")).alias("family"),
        text("date").alias("date"),
        number("horizon").alias("horizon"),
    )


def numbered_rows(raw: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of files with their number, from 1, in order of file path and position.

    Each split of a file is read by one task, in order; its rows are counted, and the sums over the splits
    before it (one row for each split) are its offset.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(offsets, ["_file", "_start"]).select(
        *raw.columns, (F.col("_offset") + F.col("_at") - F.col("_first") + 1).alias(name))
