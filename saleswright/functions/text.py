"""Series, node and request identifiers, and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_id(store: Column, family: Column) -> Column:
    """``<store>_<family>``; null if either part is null."""
    return F.concat(store.cast("string"), F.lit("_"), family)


def split_series_id(uid: Column) -> tuple[Column, Column]:
    """Undo :func:`series_id`. Only the first underscore separates, so families may hold more."""
    parts = F.split(uid, "_", 2)
    return parts.getItem(0).cast("int"), parts.getItem(1)


def store_node_id(store: Column) -> Column:
    return F.concat(F.lit("store_"), store.cast("string"))


def family_node_id(store: Column, family: Column) -> Column:
    return F.concat(store.cast("string"), F.lit("_"), F.replace(family, F.lit(" "), F.lit("_")))


def request_key(store: Column, family: Column, date: Column, horizon: Column) -> Column:
    return F.concat_ws(
        ":", F.lit("pred"), F.lit("v1"), store.cast("string"), family, date.cast("string"), horizon.cast("string")
    )


def export_name(store: Column, family: Column, start: Column, horizon: Column, extension: str = "csv") -> Column:
    slug = F.regexp_replace(F.lower(family), r"\s+", "-")
    return F.format_string(
        "forecast_store%s_%s_%s_%sd.%s",
        store.cast("string"), slug, start.cast("string"), horizon.cast("string"), F.lit(extension),
    )


def fixed(value: Column, decimals: int) -> Column:
    """Fixed decimals without grouping; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value.cast("double")))


def format_money(value: Column, thousands: int = 0, signed: bool = False) -> Column:
    """``$1.23M``, ``$4K``, ``$5``. ``signed`` judges the size by absolute value."""
    size = F.abs(value) if signed else value
    return (
        F.when(size >= 1_000_000, F.concat(F.lit("$"), fixed(value / 1_000_000, 2), F.lit("M")))
        .when(size >= 1_000, F.concat(F.lit("$"), fixed(value / 1_000, thousands), F.lit("K")))
        .when(value.isNotNull(), F.concat(F.lit("$"), fixed(value, 0)))
    )


def format_dollars(value: Column) -> Column:
    """Whole dollars with thousands separators, the sign in front."""
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(value), 0))


def format_decimal(value: Column, decimals: int = 2) -> Column:
    return F.format_number(value, decimals)


def cell(value: Column, decimals: int = 2) -> Column:
    """Text of a number in an export: fixed decimals, empty for null."""
    return F.coalesce(fixed(value, decimals), F.lit(""))
