"""Compare a Spark result with its SQL twin, column by column and as a bag of rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "-0.0" if value == 0 and math.copysign(1, value) < 0 else value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def bags(spark_df, con, sql):
    columns = sorted(spark_df.columns)
    mine = Counter(tuple(plain(row[c]) for c in columns) for row in spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns, f"columns differ: {columns} / {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in at) for row in cursor.fetchall())
    return columns, mine, theirs


def difference(spark_df, con, sql) -> str | None:
    columns, mine, theirs = bags(spark_df, con, sql)
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    key = lambda row: tuple(str(v) for v in row)
    return (
        f"{sum(mine.values())} / {sum(theirs.values())} rows, {sum(only_mine.values())} / {sum(only_theirs.values())} unmatched\n"
        f"{columns}\nspark: {sorted(only_mine, key=key)[:3]}\nsql:   {sorted(only_theirs, key=key)[:3]}"
    )
