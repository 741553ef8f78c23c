"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accuracy, calendars, cleaning, events, explanations, features, forecasts, hierarchies, lookups, observed, storage, timers

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (storage, cleaning, features, calendars, accuracy, forecasts, hierarchies, explanations, lookups, events, timers, observed)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
