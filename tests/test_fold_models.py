"""Least squares of all groups at once, against a solve per group and the single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleswright.operators import foldmodels, model, split

SCHEMA = "fold int, kind string, a double, b double, c double, sales double"


def frame(spark, n=3000):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        fold = 1 if i % 3 else (2, None)[i // 3 % 2]  # two thirds of the rows in one group, and a null key
        a, b = draw.normal(1e6, 3), draw.normal()
        rows.append((fold, "xy"[i % 2], float(a), None if i % 50 == 0 else float(b), 7.0, None if i % 40 == 0 else float(3 * a - (fold or 5) * b + draw.normal())))
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("by", [["fold"], ["fold", "kind"]])
def test_coefficients(spark, by):
    df, rows = frame(spark)
    got = {tuple(r[c] for c in by): r for r in foldmodels.fit_groups(df.repartition(5), by, ["a", "b", "c"]).collect()}
    names = SCHEMA.replace(",", "").split()[::2]
    wanted = {}
    for r in rows:
        r = dict(zip(names, r))
        if r["sales"] is not None:
            wanted.setdefault(tuple(r[c] for c in by), []).append((r["a"] - 1e6, r["b"] or 0.0, r["sales"]))
    assert set(got) == set(wanted)
    for k, values in wanted.items():
        v = np.array(values)
        x = np.column_stack([np.ones(len(v)), v[:, :2] - v[:, :2].mean(axis=0)])
        base, *betas = np.linalg.lstsq(x, v[:, 2], rcond=None)[0]
        assert got[k]["n"] == len(v) and got[k]["betas"][2] == 0.0 and got[k]["means"][2] == 7.0
        np.testing.assert_allclose([got[k]["base"], *got[k]["betas"][:2]], [base, *betas], rtol=1e-8)


def test_groups_agree_with_single_fits(spark):
    df, _ = frame(spark)
    df = df.where("sales IS NOT NULL AND fold IS NOT NULL").withColumnsRenamed({"a": "sales_lag_1", "b": "oil_price"}).drop("c", "kind")
    df = df.withColumn("sales_lag_1", F.col("sales_lag_1") - 1e6)  # the single fit loses digits on inputs far from 0
    inputs = ["oil_price", "sales_lag_1"]
    ours = foldmodels.score_groups(df, foldmodels.fit_groups(df, ["fold"], inputs), ["fold"], inputs, "ours")
    for fold in (1, 2):
        mine = ours.where(F.col("fold") == fold)
        gap = model.score(model.fit_linear(mine), mine).agg(F.max(F.abs(F.col("prediction") - F.col("ours")))).first()[0]
        assert gap < 1e-6  # sales are near 3e6


def test_odd_groups(spark):
    rows = [(1, "x", 2.0, 1.0, 1.0, 5.0), (2, "x", 1.0, 1.0, 2.0, 1.0), (2, "x", 2.0, 2.0, 4.0, 3.0), (2, "x", 3.0, 3.0, 6.0, 5.0),
            (3, "x", 1.0, 1.0, 1.0, None), (4, "x", float("nan"), None, 1.0, 2.0), (4, "x", 0.0, 0.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("base", F.lit("mine"))
    models = foldmodels.fit_groups(df, ["fold"], ["a", "b", "c"])
    scored = foldmodels.score_groups(df, models, ["fold"], ["a", "b", "c"])
    got = sorted(((r["fold"], r["prediction"]) for r in scored.collect()), key=lambda r: (r[0], r[1] or 0))
    np.testing.assert_allclose([p for f, p in got if f != 3], [5, 1, 3, 5, 3, 3], atol=1e-9)  # one row; dependent inputs; missing as 0
    assert [p for f, p in got if f == 3] == [None] and dict(scored.dtypes)["base"] == "string"
    assert foldmodels.fit_groups(df.limit(0), ["fold"], ["a"]).count() == 0


def test_cross_validation(spark):
    days = spark.range(600).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("1_A").alias("unique_id"),
        F.col("id").cast("double").alias("trend"), (F.col("id") * 2.0 + 10).alias("sales"))
    per_fold, pooled = split.cross_validate(foldmodels.fold_forecaster(["trend"]), split.walk_forward(days))
    assert [r["n_samples"] for r in per_fold.collect()] == [91] * 3
    assert pooled.first()["rmse"] < 1e-6 and pooled.first()["n_splits"] == 3
