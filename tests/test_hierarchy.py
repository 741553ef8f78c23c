import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleswright.constants import BOTTOM
from saleswright.operators import hierarchy, reconcile


def cells(spark, n_stores, n_families, values=None, day=dt.date(2020, 1, 1)):
    rows = [(s, f"F{f}", float(values[s - 1][f] if values is not None else 1.0), day) for s in range(1, n_stores + 1) for f in range(n_families)]
    return spark.createDataFrame(rows, "store_nbr int, family string, y double, ds date")


def summing_matrix(n_s, n_f):
    bottom = np.eye(n_s * n_f)
    stores = np.kron(np.eye(n_s), np.ones(n_f))
    families = np.kron(np.ones(n_s), np.eye(n_f))
    return np.vstack([np.ones(n_s * n_f), stores, families, bottom])


def node_order(n_s, n_f):
    return (["Total"] + [f"Store_{s}" for s in range(1, n_s + 1)] + [f"Family_F{f}" for f in range(n_f)]
            + [f"{s}_F{f}" for s in range(1, n_s + 1) for f in range(n_f)])


def as_vector(df, order, value="y_hat"):
    found = {r["node_id"]: r[value] for r in df.collect()}
    return np.array([found[n] for n in order])


@pytest.mark.parametrize("n_s,n_f", [(3, 2), (2, 2), (5, 4)])
def test_structure(spark, n_s, n_f):
    spec = hierarchy.hierarchy_spec(cells(spark, n_s, n_f))
    edges = hierarchy.summing_edges(spec)
    assert edges.select("node_id").distinct().count() == 1 + n_s + n_f + n_s * n_f
    assert hierarchy.validate_edges(edges).where("NOT valid").count() == 0
    positions = {r["bottom_id"]: r["position"] for r in spec.collect()}
    bottoms = node_order(n_s, n_f)[1 + n_s + n_f:]
    matrix = np.zeros((1 + n_s + n_f + n_s * n_f, n_s * n_f))
    for r in edges.collect():
        matrix[node_order(n_s, n_f).index(r["node_id"]), positions[r["bottom_id"]]] = 1
    assert [positions[b] for b in bottoms] == list(range(n_s * n_f))
    assert (matrix == summing_matrix(n_s, n_f)).all()
    assert hierarchy.validate_edges(edges.where("node_id <> 'Total' OR bottom_id <> '1_F0'")).where("NOT valid").count() == 1


def test_missing_cells_are_part_of_the_grid(spark):
    df = cells(spark, 3, 2).where("NOT (store_nbr = 2 AND family = 'F1')")
    assert hierarchy.hierarchy_spec(df).count() == 6
    tree = hierarchy.tree_nodes(df, "y")
    assert tree.where("id = '2_F1'").first()["prediction"] == 0.0
    assert tree.where("id = 'total'").first()["prediction"] == 5.0
    grid = hierarchy.complete_grid(df.withColumnRenamed("y", "sales").withColumnRenamed("ds", "date"))
    assert grid.count() == 6 and grid.where("sales = 0").count() == 1


def test_aggregation_of_known_values(spark):
    df = cells(spark, 2, 2, [[100, 200], [300, 400]])
    got = as_vector(hierarchy.aggregate_levels(df), node_order(2, 2), "y")
    assert list(got) == [1000, 300, 700, 400, 600, 100, 200, 300, 400]
    edges = hierarchy.summing_edges(hierarchy.hierarchy_spec(df))
    long = df.withColumn("unique_id", F.concat_ws("_", F.col("store_nbr").cast("string"), "family"))
    assert list(as_vector(hierarchy.aggregate_by_edges(long, edges), node_order(2, 2), "y")) == list(got)


def noisy_nodes(spark, n_s, n_f, seed=1, days=2):
    rng = np.random.default_rng(seed)
    order, rows, vectors = node_order(n_s, n_f), [], []
    s = summing_matrix(n_s, n_f)
    for d in range(days):
        y = s @ rng.uniform(50, 150, n_s * n_f) + rng.normal(0, 20, len(order))
        vectors.append(y)
        rows += [(node, dt.date(2021, 1, 1) + dt.timedelta(days=d), float(v)) for node, v in zip(order, y)]
    return split_ids(spark, rows, "y_hat"), vectors


def split_ids(spark, rows, value):
    def level(node):
        return "Total" if node == "Total" else "Store" if node.startswith("Store_") else "Family" if node.startswith("Family_") else "Bottom"

    def parts(node):
        kind = level(node)
        if kind == "Store":
            return int(node.split("_")[1]), None
        if kind == "Family":
            return None, node.split("_", 1)[1]
        return (None, None) if kind == "Total" else (int(node.split("_")[0]), node.split("_", 1)[1])

    return spark.createDataFrame([(level(n), n, *parts(n), d, v) for n, d, v in rows],
                                 f"level string, node_id string, store_nbr int, family string, ds date, {value} double")


def day(df, d):
    return df.where(F.col("ds") == dt.date(2021, 1, 1) + dt.timedelta(days=d))


@pytest.mark.parametrize("n_s,n_f", [(3, 4), (5, 2)])
def test_least_squares_equals_a_dense_solve(spark, n_s, n_f):
    nodes, vectors = noisy_nodes(spark, n_s, n_f)
    s, order = summing_matrix(n_s, n_f), node_order(n_s, n_f)
    result = reconcile.mint_ols(nodes)
    for d, y in enumerate(vectors):
        assert as_vector(day(result, d), order) == pytest.approx(s @ np.linalg.lstsq(s, y, rcond=None)[0])


def dense_shrink(e):
    """Shrunk covariance of residuals (nodes × days), straight from the definition."""
    n, t = e.shape
    x = e - e.mean(axis=1, keepdims=True)
    w = x @ x.T / (t - 1)
    sd = np.sqrt(np.diag(w))
    z = x / sd[:, None]
    r = z @ z.T / (t - 1)
    products = z[:, None, :] * z[None, :, :]
    var = t / (t - 1) ** 3 * ((products - products.mean(axis=2, keepdims=True)) ** 2).sum(axis=2)
    off = ~np.eye(n, dtype=bool)
    lam = min(1.0, max(0.0, var[off].sum() / (r[off] ** 2).sum()))
    return lam, lam * np.diag(np.diag(w)) + (1 - lam) * w


@pytest.mark.parametrize("n_s,n_f,t", [(3, 2, 40), (4, 3, 25)])
def test_minimum_trace_equals_a_dense_solve(spark, n_s, n_f, t):
    nodes, vectors = noisy_nodes(spark, n_s, n_f, seed=4)
    s, order = summing_matrix(n_s, n_f), node_order(n_s, n_f)
    e = np.random.default_rng(9).normal(0, 1, (len(order), t)) * np.linspace(1, 4, len(order))[:, None]
    e[0] += e[1] * 2
    rows = [(node, dt.date(2020, 6, 1) + dt.timedelta(days=k), float(e[i, k])) for i, node in enumerate(order) for k in range(t)]
    residuals = split_ids(spark, rows, "e")
    lam, w = dense_shrink(e)
    assert 0 < lam < 1
    assert reconcile.shrinkage(reconcile._residual_panel(residuals), t) == pytest.approx(lam)
    inverse = np.linalg.inv(w)
    p = np.linalg.solve(s.T @ inverse @ s, s.T @ inverse)
    result = reconcile.mint_shrink(nodes, residuals)
    for d, y in enumerate(vectors):
        assert as_vector(day(result, d), order) == pytest.approx(s @ p @ y)
    with pytest.raises(ValueError, match="miss days"):
        reconcile.mint_shrink(nodes, residuals.where("NOT (node_id = 'Total' AND ds = '2020-06-01')"))


def test_minimum_trace_over_a_long_history(spark):
    """As many days as the original data has: no size is refused, and the result adds up."""
    nodes, _ = noisy_nodes(spark, 2, 2)
    order = node_order(2, 2)
    e = np.random.default_rng(3).normal(0, 1, (len(order), 1684))
    rows = [(node, dt.date(2013, 1, 1) + dt.timedelta(days=k), float(e[i, k])) for i, node in enumerate(order) for k in range(1684)]
    result = reconcile.mint_shrink(nodes, split_ids(spark, rows, "e"))
    assert all(r["coherent"] for r in reconcile.check_coherence(result).collect())


def test_top_down_and_bottom_up(spark):
    nodes, vectors = noisy_nodes(spark, 3, 2)
    order = node_order(3, 2)
    down = as_vector(day(reconcile.top_down(nodes), 0), order)
    y = vectors[0]
    assert down[0] == pytest.approx(y[0])
    share = y[1:4] / y[1:4].sum()
    for i in range(3):
        inside = y[6 + 2 * i: 8 + 2 * i]
        assert down[6 + 2 * i: 8 + 2 * i] == pytest.approx(y[0] * share[i] * inside / inside.sum())
    up = as_vector(day(reconcile.bottom_up(nodes), 0), order)
    assert up == pytest.approx(summing_matrix(3, 2) @ y[6:])


def test_reconciled_levels_add_up_and_base_levels_do_not(spark):
    nodes, _ = noisy_nodes(spark, 3, 2)
    rng = np.random.default_rng(2)
    rows = [(node, dt.date(2020, 6, 1) + dt.timedelta(days=k), float(rng.normal())) for node in node_order(3, 2) for k in range(30)]
    methods = list(reconcile.METHODS)
    out = reconcile.reconcile(nodes, methods, split_ids(spark, rows, "e"))
    assert out.select("method").distinct().count() == 4
    assert reconcile.check_coherence(out, by=["method"]).where("NOT coherent").count() == 0
    assert reconcile.check_coherence(nodes).where("coherent").count() == 0
    wide = reconcile.wide(out, [f"model/{m}" for m in methods])
    assert wide.count() == 2 * len(node_order(3, 2)) and "model/MinTrace_shrink" in wide.columns
    actual = nodes.select("node_id", "ds", F.col("y_hat").alias("y"))
    scores = reconcile.evaluate_levels(out, actual)
    assert scores.count() == 16
    assert scores.where(F.col("level") == BOTTOM).where(F.col("method") == "model/BottomUp").first()["mae"] == 0.0


def test_tree_is_coherent_nested_and_searchable(spark):
    df = cells(spark, 3, 2, [[1, 2], [3, 4], [5, 6]])
    nodes = hierarchy.tree_nodes(df, "y")
    doc = hierarchy.tree_document(nodes).first()
    assert doc["prediction"] == 21 and [c["id"] for c in doc["children"]] == ["store_1", "store_2", "store_3"]
    for store in doc["children"]:
        assert sum(c["prediction"] for c in store["children"]) == store["prediction"]
    assert [r["share_percent"] for r in hierarchy.children(nodes, "store_1").orderBy("id").collect()] == pytest.approx([100 / 3, 200 / 3])
    assert hierarchy.search_nodes(nodes, "STORE 2").count() == 1 and hierarchy.search_nodes(nodes, " ").count() == 10
    proxy = {r["id"]: r["prediction"] for r in hierarchy.proxy_nodes(df, value="y").collect()}
    assert proxy["total"] == 21 and proxy["store_1"] == 1.5 * 2 * 30 and proxy["1_F0"] == 30
