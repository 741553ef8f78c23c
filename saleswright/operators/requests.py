"""Batch requests: validation, splitting, caps, lookups, history and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FAMILIES, HORIZONS, MAX_BATCH, N_FEATURES
from ..functions.dates import forecast_grid, history_grid

Rule = tuple[Column, str, Column]


# Fixed values in the rules below: error codes and messages, in the order in which they are checked.
def _rules(families: Sequence[str] | Column, max_store: int | None, with_features: bool) -> list[Rule]:
    """Condition of failure, code and message, in the order they are checked."""
    store, family, date, horizon = F.col("store_nbr"), F.col("family"), F.col("date"), F.col("horizon")
    known = family.isin(*families) if not isinstance(families, Column) else F.array_contains(families, family)
    bad_store = store.isNull() | (store <= 0)
    store_text = "store_nbr must be positive"
    if max_store is not None:
        bad_store = bad_store | (store > max_store)
        store_text = f"store_nbr must be between 1 and {max_store}"
    iso = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
    rules = [
        (bad_store, "INVALID_STORE", F.lit(store_text)),
        (F.coalesce(family, F.lit("")) == "", "MISSING_FAMILY", F.lit("family is required")),
        (~known, "INVALID_FAMILY", F.concat(F.lit("invalid family name: "), family)),
        (F.coalesce(date, F.lit("")) == "", "MISSING_DATE", F.lit("date is required")),
        (iso.isNull(), "INVALID_DATE", F.lit("date must be in YYYY-MM-DD format")),
        (horizon.isNull() | ~horizon.isin(*HORIZONS), "INVALID_HORIZON", F.lit("horizon must be 15, 30, 60, or 90")),
    ]
    if with_features:
        n = F.coalesce(F.size("features"), F.lit(0))
        rules += [
            (n <= 0, "MISSING_FEATURES", F.lit("features are required")),
            (n != N_FEATURES, "INVALID_FEATURES", F.format_string(f"features must have exactly {N_FEATURES} elements, got %d", n)),
        ]
    return rules


def validate_requests(df: DataFrame, families: Sequence[str] | Column = FAMILIES, max_store: int | None = None) -> DataFrame:
    """Add ``code`` and ``message`` of the first rule a request breaks; null for a valid one.

    ``date`` is text here. ``features`` is checked if the column exists.
    """
    code, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for failed, rule_code, text in reversed(_rules(families, max_store, "features" in df.columns)):
        code = F.when(failed, rule_code).otherwise(code)
        message = F.when(failed, text).otherwise(message)
    return df.withColumns({"code": code, "message": message})


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("code").isNull()
    return validated.where(good).drop("code", "message"), validated.where(~good)


def error_summary(invalid: DataFrame, limit: int = 10, position: str = "row_id") -> DataFrame:
    """The first errors by position, and a line for the remaining ones. A top-k report, not a sample."""
    line = F.format_string("Row %d: %s", F.col(position), F.col("message"))
    first = invalid.orderBy(position).limit(limit).select(F.col(position).alias("position"), line.alias("text"))
    more = invalid.agg((F.count(F.lit(1)) - limit).alias("_more"), F.max(position).alias("_last")).where(F.col("_more") > 0)
    return first.unionByName(
        more.select((F.col("_last") + 1).alias("position"), F.format_string("... and %d more errors", F.col("_more")).alias("text"))
    )


def batch_size_code(df: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), F.when(n == 0, "EMPTY_BATCH").when(n > limit, "BATCH_TOO_LARGE").alias("code"))


def cap_batch(df: DataFrame, limit: int = MAX_BATCH, policy: str = "first", position: str = "row_id") -> DataFrame:
    """``first`` keeps the first rows by position; ``reject`` raises for an empty or oversized batch.

    Rejecting counts no further than one row past the limit.
    """
    if policy == "first":
        return df.orderBy(position).limit(limit)
    n = df.limit(limit + 1).count()
    if n == 0 or n > limit:
        raise ValueError("EMPTY_BATCH" if n == 0 else "BATCH_TOO_LARGE")
    return df


def batch_status(results: DataFrame) -> DataFrame:
    return results.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "error", "pending")])


def series_profile(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("store_nbr", "family")) -> DataFrame:
    """Mean vector per series; a null counts as 0, as it does in the stored vectors."""
    return features.groupBy(*keys).agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])


def lookup_features(requests: DataFrame, features: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Features of each request: those of its day, else the mean of its series, else zeros; ``source`` says which.

    The exact rows and the means stay narrow structs, and both joins are plain equi-joins: AQE
    broadcasts a small side and splits a skewed one.
    """
    keys = ["store_nbr", "family"]

    def packed(df: DataFrame, name: str) -> Column:
        return F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).alias(name)

    # One entry for each key, as a lookup table has: of repeated feature rows the greatest, value by value in column order.
    exact = features.select(*keys, F.col("date").alias(date), packed(features, "_exact")).groupBy(*keys, date).agg(F.max("_exact").alias("_exact"))
    means = series_profile(features, columns, keys).select(*keys, packed(features, "_mean"))
    found = requests.join(exact, [*keys, date], "left").join(means, keys, "left")
    return found.withColumns(
        {
            **{c: F.coalesce(F.col(f"_exact.{c}"), F.col(f"_mean.{c}"), F.lit(0.0)) for c in columns},
            "source": F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_mean").isNotNull(), "aggregated").otherwise("zero_fallback"),
        }
    ).drop("_exact", "_mean")


def history(requests: DataFrame, actuals: DataFrame, features: DataFrame) -> DataFrame:
    """Weekly history of each request: the sales of the day, else a positive seven-day lag of the lookup.

    ``requests``: row_id, store_nbr, family, end_date, days. Dates with neither are left out. Of repeated actuals
    of one day the largest counts.
    """
    grid = history_grid(requests).select("row_id", "store_nbr", "family", "date")
    known = grid.join(
        actuals.groupBy("store_nbr", "family", "date").agg(F.max(F.col("sales").cast("double")).alias("_sales")),
        ["store_nbr", "family", "date"], "left",
    )
    looked_up = lookup_features(known, features, ["sales_lag_7"])
    lag = F.when((F.col("sales_lag_7") > 0) & (F.col("source") != "zero_fallback"), F.col("sales_lag_7"))
    return looked_up.select(
        "row_id", "store_nbr", "family", "date", F.coalesce("_sales", lag).alias("actual"),
        F.when(F.col("_sales").isNotNull(), "actual").otherwise("lag").alias("origin"),
    ).where(F.col("actual").isNotNull())


def compare_series(pairs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Two series side by side on the weekly grid of their request; a missing side stays null.

    ``pairs``: row_id, id_a, id_b, date, horizon. ``forecasts``: unique_id, ds, prediction, lower_80, upper_80.
    """
    grid = forecast_grid(pairs).select("row_id", "id_a", "id_b", "ds")
    out = grid
    for side in ("a", "b"):
        named = forecasts.select(
            F.col("unique_id").alias(f"id_{side}"), "ds", F.col("prediction").alias(f"store_{side}"),
            F.col("lower_80").alias(f"lower_80_{side}"), F.col("upper_80").alias(f"upper_80_{side}"),
        )
        out = out.join(named, [f"id_{side}", "ds"], "left")
    return out


def forecast_series(actuals: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """History and forecast as one frame of points: date, actual, forecast, bands. Order by date where shown."""
    points = actuals.select(*keys, "date", "actual").unionByName(forecasts, allowMissingColumns=True)
    wanted = [*keys, "date", "actual", "forecast", "lower_80", "upper_80", "lower_95", "upper_95"]
    return points.select(*[c for c in wanted if c in points.columns])


def transition_date(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Date of the point right before the first pure forecast; null if the series starts with one."""
    pure = F.col("actual").isNull() & F.col("forecast").isNotNull()
    first = points.groupBy(*keys).agg(F.min(F.when(pure, F.col("date"))).alias("_first"))
    joined = points.join(first, list(keys)) if keys else points.withColumn("_first", first.scalar())
    return joined.groupBy(*keys).agg(F.max(F.when(F.col("date") < F.col("_first"), F.col("date"))).alias("transition_date"))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows, the same ones for the same seed. A distributed top-n on a hash of the key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
