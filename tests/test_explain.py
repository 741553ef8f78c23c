import math

import pytest
from pyspark.sql import functions as F

from saleswright.operators import explain, linear, model, whatif
from saleswright.operators.evaluate import feature_importance
from saleswright.plans.features import build_feature_matrix


def packed(spark, values, base=100.0, names=None):
    names = names or [f"f{i}" for i in range(len(values))]
    df = spark.createDataFrame([(1, base, names, [float(v) * 2 for v in values], [float(v) for v in values])],
                               "id int, base_value double, names array<string>, values array<double>, shap_values array<double>")
    return df.withColumn("contributions", explain.contributions_from_arrays(df))


def test_largest_contribution_first(spark):
    steps = explain.waterfall(packed(spark, [10, 20], names=["a", "b"])).first()
    assert [(s["name"], s["cumulative"]) for s in steps["steps"]] == [("b", 120.0), ("a", 130.0)]
    assert steps["prediction"] == 130.0 and steps["steps"][0]["value"] == 40.0


def test_the_rest_is_one_step(spark):
    row = explain.waterfall(packed(spark, [0.5, 0.4, 0.3, 0.2, 0.1]), k=2).first()
    assert len(row["steps"]) == 3
    last = row["steps"][2]
    assert last["name"] == "Other (3 features)" and last["contribution"] == pytest.approx(0.6) and last["value"] is None
    assert row["prediction"] == pytest.approx(101.5)


def test_a_small_rest_is_left_out(spark):
    assert len(explain.waterfall(packed(spark, [5, 4, 0.001]), k=2).first()["steps"]) == 2
    assert explain.waterfall(packed(spark, [-5, 0]), k=2).first()["steps"][0]["direction"] == "negative"


def test_segments(spark):
    bars = explain.waterfall_segments(explain.waterfall(packed(spark, [10, -30])), ["id"]).orderBy("bar").collect()
    assert [(b["name"], b["start"], b["end"]) for b in bars] == [
        ("Base Value", 0.0, 100.0), ("f1", 70.0, 100.0), ("f0", 70.0, 80.0), ("Prediction", 0.0, 80.0)]


def test_importance_and_gate(spark):
    df = packed(spark, [1, -5, 2]).unionByName(packed(spark, [1, 5, 2]))
    long = explain.explode_contributions(df, ["id"])
    assert [r["feature"] for r in feature_importance(long).collect()] == ["f1", "f2", "f0"]
    good = df.withColumn("prediction", F.col("base_value") + F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v))
    assert explain.contribution_gate(good).first()["passed"]
    assert explain.contribution_gate(good.withColumn("prediction", F.lit(0.0))).first()["n_not_additive"] == 2
    bad = packed(spark, [1, math.nan]).withColumn("prediction", F.lit(1.0))
    assert explain.contribution_gate(bad).first()["n_not_finite"] == 1


def test_first_match_per_key(spark, fact):
    rows = fact.withColumn("base_value", F.lit(1.0)).withColumn("contributions", packed(spark, [1]).select("contributions").scalar())
    first = explain.export_waterfalls(rows, fact.where("store_nbr = 1").select("store_nbr", "family"))
    assert first.count() == 2 and {str(r["date"]) for r in first.collect()} == {"2017-01-01"}
    assert explain.export_waterfalls(rows, n=7).count() == 7


@pytest.fixture(scope="module")
def lines(fact):
    feats = build_feature_matrix(fact, 28)
    names = ("onpromotion", "month", "dayofweek", "sales_lag_7")
    return feats, linear.marginal_linear(feats, names)


def test_contributions_add_up(lines):
    feats, fitted = lines
    rows = linear.linear_contributions(feats, fitted)
    gate = explain.contribution_gate(rows, limit=1e9).first()
    assert gate["passed"] and gate["n_rows"] == feats.count()


def test_regression_and_linear_model_agree(fact):
    feats = build_feature_matrix(fact, 28)
    numeric, _ = model.available(feats)
    numeric = [c for c in numeric if c not in ("year", "is_leap_year")]
    narrow = feats.select("unique_id", "date", "sales", *numeric)
    fitted = model.fit_linear(narrow, regularisation=0.1)
    ours = linear.score_linear(narrow, linear.from_regression(fitted.stages[-1], narrow, numeric), "mine")
    gap = model.score(fitted, ours).agg(F.max(F.abs(F.col("mine") - F.col("prediction")))).first()[0]
    assert gap < 1e-6


def test_what_if_rules(lines):
    feats, fitted = lines
    base = feats.limit(1)

    def run(**adjustments):
        pairs = [x for k, v in adjustments.items() for x in (F.lit(k), F.lit(float(v)))]
        return whatif.what_if(base.withColumn("adjustments", F.create_map(*pairs)), fitted).first()

    beta = dict(zip(fitted.features, fitted.betas))
    x = base.first()
    assert run(sales_lag_7=1.0)["delta"] == 0.0
    assert run(sales_lag_7=1.2)["delta"] == pytest.approx(beta["sales_lag_7"] * x["sales_lag_7"] * 0.2)
    assert run(onpromotion=0.6)["delta"] == pytest.approx(beta["onpromotion"] * (1 - x["onpromotion"]))
    assert run(day_of_week=9)["delta"] == pytest.approx(beta["dayofweek"] * (7 - x["dayofweek"]))
    assert run(month=0)["delta"] == pytest.approx(beta["month"] * (1 - x["month"]))
    odd = run(is_payday=1, transactions=2, month=3)
    assert odd["skipped"] == ["is_payday", "transactions"] and odd["applied"] == {"month": 3.0}
    got = run(sales_lag_7=1.5)
    assert got["delta_pct"] == pytest.approx(got["delta"] / got["original"] * 100)


def test_sensitivity_covers_the_grid(lines):
    feats, fitted = lines
    out = whatif.sensitivity(feats.limit(3), fitted)
    assert out.count() == 3 * len(whatif.sensitivity_grid()) == 3 * 25


def test_trained_models(spark, fact, tmp_path):
    from saleswright.operators.split import cross_validate, folds, time_split, walk_forward

    feats = build_feature_matrix(fact, 14)
    train, valid = time_split(feats, 20)
    fitted = model.fit_gbt(train, valid, rounds=3, depth=2)
    scored = model.score(fitted, valid)
    assert scored.count() == valid.count() and scored.where(F.isnan("prediction") | F.col("prediction").isNull()).count() == 0
    again = model.load(model.save(fitted, str(tmp_path / "m")))
    assert model.score(again, valid).exceptAll(scored).count() == 0
    cut = dict(train_days=50, valid_days=10, n_splits=2, step_days=10)
    rows = walk_forward(feats, **cut)
    fit = lambda tr, va: model.fit_linear(tr, regularisation=0.1)
    per_fold, pooled = cross_validate(model.trained_forecaster(fit, folds(feats, **cut)), rows)
    assert per_fold.count() == 2 and pooled.first()["n_samples"] == 2 * 11 * 4
    encoder = model.fit_encoder(train.withColumn("type", F.lit("A")))
    coded = model.encode(valid.withColumn("type", F.lit("Z")), encoder)
    assert {r[0] for r in coded.select("type_encoded").distinct().collect()} == {1.0}
