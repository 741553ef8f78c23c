"""Left joins of the sales fact with oil price, store metadata and holidays.

The side tables hold one row per date or per store. None is hinted: Spark broadcasts them as long as
their size stays under its threshold and falls back to a shuffle join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import fill_defaults, national_holidays


def forward_fill(df: DataFrame, col: str, order: str = "date", out: str | None = None) -> DataFrame:
    """Last non-null value so far, in date order.

    Meant for a calendar frame (one row per date): the frame is ordered as a whole, which is bounded
    by the number of days and never by the number of sales rows.
    """
    so_far = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or col, F.last(col, ignorenulls=True).over(so_far))


def oil_calendar(fact: DataFrame, oil: DataFrame) -> DataFrame:
    """date → oil_price for each date of the fact: filled forward, the head with the row-weighted median."""
    quotes = forward_fill(oil.select("date", "dcoilwtico"), "dcoilwtico", out="oil_price").select("date", "oil_price")
    days = fact.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))
    filled = forward_fill(days.join(quotes, "date", "left"), "oil_price")
    # Weighting each date by its rows gives the median over the joined fact, computed on the calendar.
    median = F.percentile("oil_price", F.lit(0.5), F.col("n_rows")).over(Window.partitionBy(F.lit(0)))
    return filled.select("date", F.coalesce("oil_price", median).alias("oil_price"))


def join_oil(fact: DataFrame, oil: DataFrame) -> DataFrame:
    return fact.join(oil_calendar(fact, oil), "date", "left")


def join_stores(fact: DataFrame, stores: DataFrame) -> DataFrame:
    return fact.join(stores, "store_nbr", "left")


def join_holidays(fact: DataFrame, holidays: DataFrame) -> DataFrame:
    return fill_defaults(fact.join(national_holidays(holidays), "date", "left"), {"is_holiday": 0})


def enrich(fact: DataFrame, external: dict[str, DataFrame]) -> DataFrame:
    """Apply the joins whose side table is present, in the order oil, stores, holidays."""
    steps = (("oil", join_oil), ("stores", join_stores), ("holidays", join_holidays))
    df = fact
    for name, step in steps:
        if name in external:
            df = step(df, external[name])
    return df
