import datetime as dt
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from saleswright.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "saleswright-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def fact(spark):
    """Two stores, two families, 120 days; sales = 100 + 10·i + 5·store + 3·family."""
    start = dt.date(2017, 1, 1)
    rows = [
        (start + dt.timedelta(days=i), store, family, 100.0 + 10 * i + 5 * store + 3 * f, i % 3)
        for store in (1, 2)
        for f, family in enumerate(("GROCERY", "DAIRY"))
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion long").cache()


def days(spark, n, start="2017-01-01", **columns):
    """n rows of one series from a first day, with further columns given as lists."""
    first = dt.date.fromisoformat(start)
    names = list(columns)
    rows = [(first + dt.timedelta(days=i), *[columns[c][i] for c in names]) for i in range(n)]
    types = {str: "string", int: "int", float: "double"}
    kinds = [types[type(next(v for v in columns[c] if v is not None))] for c in names]
    return spark.createDataFrame(rows, ", ".join(["date date", *[f"{c} {k}" for c, k in zip(names, kinds)]]))


@pytest.fixture
def make_days(spark):
    return lambda n, **kw: days(spark, n, **kw)
