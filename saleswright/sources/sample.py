"""Map the sample star-schema tables to the sales domain.

The grain picks what counts as a store: ``region`` (5 stores) or ``nation`` (25 stores); a family is a
market segment. Money is summed per day and rounded to cents so that results do not depend on the
order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOLIDAY_DAYS = ("01-01", "02-14", "05-01", "05-24", "08-10", "10-09", "11-02", "12-25")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_fact(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """date, store_nbr, family, sales, onpromotion: one row per series and day with sales."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", F.col("l_shipdate").cast("date").alias("date")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    key = F.col("c_nationkey")
    if grain == "region":
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("n_regionkey")
    return joined.groupBy(
        "date", (key + 1).cast("int").alias("store_nbr"), F.col("c_mktsegment").alias("family")
    ).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("sales"),
        F.count_if(F.col("l_discount") > 0.05).alias("onpromotion"),
    )


def oil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekday price series with gaps: mean order value in whole cents, null on days 11, 22 of a month."""
    day = F.col("o_orderdate").cast("date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    daily = (
        table(spark, sf_dir, "orders")
        .select(day.alias("date"), cents.alias("cents"))
        .where(F.weekday("date") < 5)
        .groupBy("date")
        .agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    price = F.expr("total div n") / 100
    return daily.select(
        "date", F.when(F.dayofmonth("date") % 11 != 0, price).alias("dcoilwtico")
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates that fall on a fixed list of days; National in even years, Local in odd ones."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return dates.where(F.date_format("date", "MM-dd").isin(*HOLIDAY_DAYS)).select(
        "date",
        F.lit("Holiday").alias("type"),
        F.when(F.year("date") % 2 == 0, "National").otherwise("Local").alias("locale"),
    )


def stores(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    source, prefix = (table(spark, sf_dir, "region"), "r_region") if grain == "region" else (
        table(spark, sf_dir, "nation"), "n_nation")
    key: Column = F.col(f"{prefix}key")
    return source.select(
        (key + 1).cast("int").alias("store_nbr"),
        F.col(f"{prefix[:2]}name").alias("city"),
        F.char((F.lit(65) + key % 5).cast("long")).alias("type"),
        (key % 3).cast("int").alias("cluster"),
    )


def external(spark: SparkSession, sf_dir: str, grain: str = "region") -> dict[str, DataFrame]:
    return {
        "oil": oil(spark, sf_dir),
        "holidays": holidays(spark, sf_dir),
        "stores": stores(spark, sf_dir, grain),
    }


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service request events: time, endpoint, method, status, seconds and two lookup labels."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 1000).alias("seconds"),
        F.when(F.col("event_id") % 3 == 0, "hit").otherwise("miss").alias("cache"),
        F.when(F.col("event_id") % 7 == 0, "zero_fallback")
        .when(F.col("event_id") % 2 == 0, "aggregated")
        .otherwise("exact")
        .alias("lookup"),
    )
