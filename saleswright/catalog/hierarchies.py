"""Hierarchy tables, reconciliation and the display tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BOTTOM, FAMILY, STORE, TOTAL
from ..functions.text import series_id
from ..operators import hierarchy, reconcile, windows
from ..operators.facts import latest
from ..sources.stages import materialised, staged
from . import base
from .base import define, r, rounded, sql_table

WEEKS = {TOTAL: 3, STORE: 6, FAMILY: 6, BOTTOM: 7}
"""Base forecast of a level: mean of the same weekday over so many weeks. They differ, so levels disagree."""


def nation_fact(spark, sf_dir) -> DataFrame:
    return base.fact(spark, sf_dir, "nation")


def base_forecasts(spark, sf_dir) -> DataFrame:
    """level, node_id, store_nbr, family, ds, y_hat for the last 7 days, from the days before them, on the full grid."""
    return staged(spark, ("base_forecasts", sf_dir), lambda: _base_forecasts(past(spark, sf_dir), nation_fact(spark, sf_dir)))


def past(spark, sf_dir) -> DataFrame:
    """All days but the last 7, which are held out."""
    fact = nation_fact(spark, sf_dir)
    return fact.where(F.col("date") <= F.date_sub(latest(fact.select("date")), 7))


def _base_forecasts(fact: DataFrame, everything: DataFrame) -> DataFrame:
    last = F.date_sub(latest(everything.select("date")), 7)
    age = F.datediff("_last", "date")
    recent = fact.withColumn("_last", last).where(age < 49).select(
        "store_nbr", "family", (7 - age % 7).alias("k"), (F.floor(age / 7) + 1).alias("week"), "sales"
    )
    means = {n: F.sum(F.when(F.col("week") <= n, F.col("sales")).otherwise(0.0)) / n for n in sorted(set(WEEKS.values()))}
    cells = recent.groupBy("store_nbr", "family", "k").agg(*[v.alias(f"m{n}") for n, v in means.items()])
    grid = hierarchy.hierarchy_spec(everything).select("store_nbr", "family", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    full = grid.join(cells, ["store_nbr", "family", "k"], "left").withColumn("ds", F.date_add(last, F.col("k")))
    per_level = [
        hierarchy.aggregate_levels(full.withColumn("y_hat", F.coalesce(f"m{n}", F.lit(0.0))), "y_hat").where(
            F.col("level").isin([level for level, weeks in WEEKS.items() if weeks == n])
        )
        for n in means
    ]
    out = per_level[0]
    for part in per_level[1:]:
        out = out.unionByName(part)
    return out.withColumn("y_hat", F.round("y_hat", 6))


def residuals(spark, sf_dir) -> DataFrame:
    """One-week errors of every node over all days before the held-out ones; aggregates look two weeks back."""
    fact = past(spark, sf_dir)
    nodes = hierarchy.aggregate_levels(hierarchy.complete_grid(fact).withColumnRenamed("date", "ds"), "sales")
    w = Window.partitionBy("node_id").orderBy("ds")
    week, fortnight = F.lag("sales", 7).over(w), F.lag("sales", 14).over(w)
    expected = F.when(F.col("level") == BOTTOM, week).otherwise((week + fortnight) / 2)
    errors = nodes.withColumn("e", F.col("sales") - expected).withColumn("_known", fortnight.isNotNull())
    return errors.where("_known").select("level", "node_id", "store_nbr", "family", "ds", "e")


def actual_nodes(spark, sf_dir) -> DataFrame:
    """The held-out days as they were."""
    fact = nation_fact(spark, sf_dir)
    held = fact.where(F.col("date") > F.date_sub(latest(fact.select("date")), 7)).withColumnRenamed("date", "ds")
    return hierarchy.aggregate_levels(held, "sales").withColumnRenamed("sales", "y")


def _plain(nodes: DataFrame, places: int = 4) -> DataFrame:
    return rounded(nodes.select("level", "node_id", "ds", "y_hat"), places, "y_hat")


def h1_hierarchy_spec(spark, sf_dir):
    return hierarchy.hierarchy_spec(nation_fact(spark, sf_dir))


def h2_summing_edges(spark, sf_dir):
    return hierarchy.summing_edges(hierarchy.hierarchy_spec(nation_fact(spark, sf_dir)))


def h3_validated_edges(spark, sf_dir):
    return hierarchy.validate_edges(h2_summing_edges(spark, sf_dir))


def h4_aggregated_levels(spark, sf_dir):
    rows = nation_fact(spark, sf_dir).withColumnRenamed("date", "ds")
    return rounded(hierarchy.aggregate_levels(rows, "sales"), 2, "sales")


def h4_aggregated_by_edges(spark, sf_dir):
    rows = nation_fact(spark, sf_dir).select(
        series_id(F.col("store_nbr"), F.col("family")).alias("unique_id"), F.trunc("date", "month").alias("ds"), F.col("sales").alias("y")
    )
    return rounded(hierarchy.aggregate_by_edges(rows, h2_summing_edges(spark, sf_dir)), 2, "y")


def h5_bottom_up(spark, sf_dir):
    return _plain(reconcile.bottom_up(base_forecasts(spark, sf_dir)), 6)


def h6_top_down(spark, sf_dir):
    return _plain(reconcile.top_down(base_forecasts(spark, sf_dir)))


def h7_mint_ols(spark, sf_dir):
    return _plain(reconcile.mint_ols(base_forecasts(spark, sf_dir)))


def h8_mint_shrink(spark, sf_dir):
    return _plain(reconcile.mint_shrink(base_forecasts(spark, sf_dir), residuals(spark, sf_dir)))


def h8_mint_shrink_levels(spark, sf_dir):
    """How many published values each level has, and how far they are from the sums of their bottom series."""
    checked = reconcile.check_coherence(reconcile.mint_shrink(base_forecasts(spark, sf_dir), residuals(spark, sf_dir)), 1e-3)
    return checked.select("level", "n_nodes", r(F.col("max_gap"), 3).alias("max_gap"), "coherent")


SQL_METHODS = ("BottomUp", "TopDown", "MinTrace_ols")


def reconciled(spark, sf_dir) -> DataFrame:
    return reconcile.reconcile(base_forecasts(spark, sf_dir), SQL_METHODS, model="mean")


def h9_reconciled_wide(spark, sf_dir):
    names = [f"mean/{m}" for m in SQL_METHODS]
    return rounded(rounded(reconcile.wide(reconciled(spark, sf_dir), names), 6, names[0]), 4, *names[1:])


def _evaluation(spark, sf_dir) -> DataFrame:
    return reconcile.evaluate_levels(reconciled(spark, sf_dir), actual_nodes(spark, sf_dir))


def h10_level_evaluation(spark, sf_dir):
    return rounded(_evaluation(spark, sf_dir), 3, "mape", "rmse", "mae")


def l4_best_method(spark, sf_dir):
    from ..operators.evaluate import best_method

    evaluation = materialised(_evaluation(spark, sf_dir), "evaluation")  # a row for each method and level, read four times
    picks = [best_method(evaluation, "rmse", level).withColumn("level", F.lit(level or "all")) for level in (None, TOTAL, STORE, BOTTOM)]
    out = picks[0]
    for pick in picks[1:]:
        out = out.unionByName(pick)
    return rounded(out, 3, "score")


def h11_coherence(spark, sf_dir):
    """Base forecasts are not coherent, reconciled ones are."""
    raw = base_forecasts(spark, sf_dir).select(F.lit("base").alias("method"), "level", "store_nbr", "family", "ds", "y_hat")
    rows = raw.unionByName(reconciled(spark, sf_dir).drop("node_id"))
    checked = reconcile.check_coherence(materialised(rows, "published"), tol=1e-3, by=["method"])
    return checked.select("method", "level", "n_nodes", r(F.col("max_gap"), 2).alias("max_gap"), "coherent")


def j5_forecast_actuals(spark, sf_dir):
    forecast = base_forecasts(spark, sf_dir).select("node_id", "ds", "y_hat")
    both = reconcile.join_actuals(forecast, actual_nodes(spark, sf_dir).select("node_id", "ds", "y"), "node_id")
    return rounded(both, 6, "y_hat", "y")


def h12_tree_nodes(spark, sf_dir):
    return rounded(hierarchy.tree_nodes(nation_fact(spark, sf_dir)), 2, "prediction")


def h12_store_trees(spark, sf_dir):
    return hierarchy.store_trees(h12_tree_nodes(spark, sf_dir))


def h12_tree_document(spark, sf_dir):
    return hierarchy.tree_document(h12_tree_nodes(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("document"))


def h12_yearly_trends(spark, sf_dir):
    by_year = nation_fact(spark, sf_dir).withColumn("year", F.year("date"))
    nodes = rounded(hierarchy.tree_nodes(by_year, by=("year",)), 2, "prediction")
    trends = windows.with_trend(nodes, ["id"], "year")
    return rounded(trends.select("year", "id", "prediction", "previous_prediction", "trend_percent"), 3, "trend_percent")


def h13_proxy_nodes(spark, sf_dir):
    return rounded(hierarchy.proxy_nodes(nation_fact(spark, sf_dir)), 5, "prediction")


def h14_children(spark, sf_dir):
    nodes = h12_tree_nodes(spark, sf_dir)
    both = hierarchy.children(nodes, "total").unionByName(hierarchy.children(nodes, "store_1"))
    return rounded(both.select("id", "parent_id", "prediction", "share_percent"), 4, "share_percent")


QUERIES = {
    f.__name__: f
    for f in (
        h1_hierarchy_spec, h2_summing_edges, h3_validated_edges, h4_aggregated_levels, h4_aggregated_by_edges, h5_bottom_up,
        h6_top_down, h7_mint_ols, h8_mint_shrink, h8_mint_shrink_levels, h9_reconciled_wide, h10_level_evaluation, l4_best_method, h11_coherence,
        j5_forecast_actuals, h12_tree_nodes, h12_store_trees, h12_tree_document, h12_yearly_trends, h13_proxy_nodes, h14_children,
    )
}

# --- SQL ----------------------------------------------------------------------------------------

_KEY = """CASE WHEN store_nbr IS NULL AND family IS NULL THEN 'Total' WHEN family IS NULL THEN 'Store_' || store_nbr
       WHEN store_nbr IS NULL THEN 'Family_' || family ELSE store_nbr || '_' || family END"""
_LEVEL = """CASE WHEN store_nbr IS NULL AND family IS NULL THEN 'Total' WHEN family IS NULL THEN 'Store'
       WHEN store_nbr IS NULL THEN 'Family' ELSE 'Bottom' END"""


def _levels(source: str, value: str, ds: str = "ds", out: str = "y_hat") -> str:
    return f"""SELECT {_LEVEL} AS level, {_KEY} AS node_id, store_nbr, family, {ds} AS ds, {value} AS {out} FROM {source}
GROUP BY GROUPING SETS (({ds}), ({ds}, store_nbr), ({ds}, family), ({ds}, store_nbr, family))"""


define("cells", """
SELECT store_nbr, family FROM (SELECT DISTINCT store_nbr FROM fact_nation) CROSS JOIN (SELECT DISTINCT family FROM fact_nation)""")
define("spec", """
SELECT CAST((dense_rank() OVER (ORDER BY store_nbr) - 1) * nf + dense_rank() OVER (ORDER BY family) - 1 AS INTEGER) AS position,
       store_nbr || '_' || family AS bottom_id, store_nbr, family, 'Total' AS total_label, 'Store_' || store_nbr AS store_label,
       'Family_' || family AS family_label, CAST(ns AS INTEGER) AS n_stores, CAST(nf AS INTEGER) AS n_families, CAST(ns * nf AS INTEGER) AS n_bottom
FROM cells, (SELECT count(DISTINCT store_nbr) AS ns, count(DISTINCT family) AS nf FROM fact_nation)""")
define("edges", " UNION ALL ".join(
    f"SELECT '{level}' AS level, {label} AS node_id, bottom_id, n_stores, n_families, n_bottom FROM spec"
    for level, label in ((TOTAL, "total_label"), (STORE, "store_label"), (FAMILY, "family_label"), (BOTTOM, "bottom_id"))
))
define("fact_past", "SELECT * FROM fact_nation WHERE date <= (SELECT max(date) - 7 FROM fact_nation)")
define("base_cells", """
SELECT c.store_nbr, c.family, CAST(l.last + CAST(k AS INTEGER) AS DATE) AS ds,
       coalesce(sum(sales) FILTER (WHERE age // 7 < 3), 0) / 3 AS m3, coalesce(sum(sales) FILTER (WHERE age // 7 < 6), 0) / 6 AS m6,
       coalesce(sum(sales) FILTER (WHERE age // 7 < 7), 0) / 7 AS m7
FROM cells c CROSS JOIN range(1, 8) t(k) CROSS JOIN (SELECT max(date) - 7 AS last FROM fact_nation) l
LEFT JOIN (SELECT *, (SELECT max(date) - 7 FROM fact_nation) - date AS age FROM fact_past) f
  ON f.store_nbr = c.store_nbr AND f.family = c.family AND f.age < 49 AND 7 - f.age % 7 = k
GROUP BY c.store_nbr, c.family, l.last, k""")
define("base_nodes", f"""
SELECT level, node_id, store_nbr, family, ds, round(CASE level WHEN 'Total' THEN m3 WHEN 'Bottom' THEN m7 ELSE m6 END, 6) AS y_hat
FROM (SELECT {_LEVEL} AS level, {_KEY} AS node_id, store_nbr, family, ds, sum(m3) AS m3, sum(m6) AS m6, sum(m7) AS m7 FROM base_cells
      GROUP BY GROUPING SETS ((ds), (ds, store_nbr), (ds, family), (ds, store_nbr, family)))""")
define("base_wide", """
SELECT b.ds, b.store_nbr, b.family, b.y_hat AS b, s.y_hat AS s, f.y_hat AS f, t.y_hat AS t
FROM base_nodes b JOIN base_nodes s ON s.level = 'Store' AND s.store_nbr = b.store_nbr AND s.ds = b.ds
JOIN base_nodes f ON f.level = 'Family' AND f.family = b.family AND f.ds = b.ds
JOIN base_nodes t ON t.level = 'Total' AND t.ds = b.ds WHERE b.level = 'Bottom'""")
define("bottom_td", """
SELECT ds, store_nbr, family, t * coalesce(s / nullif(all_s, 0), 0) * coalesce(b / nullif(store_b, 0), 0) AS v
FROM (SELECT *, sum(b) OVER (PARTITION BY ds, store_nbr) AS store_b,
             (SELECT sum(y_hat) FROM base_nodes n WHERE n.level = 'Store' AND n.ds = w.ds) AS all_s FROM base_wide w)""")
define("bottom_ols", """
SELECT ds, store_nbr, family, v - sum(v) OVER (PARTITION BY ds, store_nbr) / (1 + nf) - sum(v) OVER (PARTITION BY ds, family) / (1 + ns)
       + sum(v) OVER (PARTITION BY ds) / ((1 + ns) * (1 + nf)) AS v
FROM (SELECT *, b + s + f + t AS v FROM base_wide), (SELECT count(DISTINCT store_nbr) AS ns, count(DISTINCT family) AS nf FROM cells)""")
define("nodes_bu", _levels("base_wide", "sum(b)"))
define("nodes_td", _levels("bottom_td", "sum(v)"))
define("nodes_ols", _levels("bottom_ols", "sum(v)"))
define("nodes_all", """
SELECT 'mean/BottomUp' AS method, * FROM nodes_bu UNION ALL SELECT 'mean/TopDown', * FROM nodes_td UNION ALL SELECT 'mean/MinTrace_ols', * FROM nodes_ols""")
define("week_rows", "SELECT *, date AS ds FROM fact_nation WHERE date > (SELECT max(date) - 7 FROM fact_nation)")
define("actual_nodes", _levels("week_rows", "sum(sales)", out="y"))
define("evaluation", """
SELECT method, n.level, avg(abs(y - y_hat) / (abs(y) + 1)) AS mape, sqrt(avg(pow(y - y_hat, 2))) AS rmse, avg(abs(y - y_hat)) AS mae, count(*) AS n_samples
FROM nodes_all n JOIN actual_nodes a ON n.node_id = a.node_id AND n.ds = a.ds GROUP BY method, n.level""")


def _tree(period: str = "") -> str:
    p, on = (f"{period}, ", f"AND q.{period} = f.{period}") if period else ("", "")
    periods = f"CROSS JOIN (SELECT DISTINCT {period} FROM yearly) q" if period else ""
    source = "yearly" if period else "fact_nation"
    qp = f"q.{period}, " if period else ""
    return f"""
SELECT {p}CASE WHEN store_nbr IS NULL THEN 'total' WHEN family IS NULL THEN 'store_' || store_nbr ELSE store_nbr || '_' || replace(family, ' ', '_') END AS id,
       CASE WHEN store_nbr IS NULL THEN 'Total' WHEN family IS NULL THEN 'Store ' || store_nbr ELSE family END AS name,
       CASE WHEN store_nbr IS NULL THEN 'total' WHEN family IS NULL THEN 'store' ELSE 'family' END AS level,
       CASE WHEN store_nbr IS NULL THEN NULL WHEN family IS NULL THEN 'total' ELSE 'store_' || store_nbr END AS parent_id,
       store_nbr, round(sum(v), 2) AS prediction
FROM (SELECT {qp}c.store_nbr, c.family, coalesce(f.sales, 0) AS v FROM cells c {periods}
      LEFT JOIN {source} f ON f.store_nbr = c.store_nbr AND f.family = c.family {on})
GROUP BY GROUPING SETS (({p[:-2]}), ({p}store_nbr), ({p}store_nbr, family))"""


define("yearly", "SELECT *, CAST(year(date) AS INTEGER) AS year FROM fact_nation")
define("tree", _tree())
define("tree_by_year", _tree("year"))

_PICK = "round(max(y_hat) FILTER (WHERE method = '{m}'), {n}) AS \"{m}\""
_BEST = "SELECT '{out}' AS level, method, round(avg(rmse), 3) AS score FROM evaluation {where} GROUP BY method ORDER BY avg(rmse) LIMIT 1"
SQL = sql_table(
    h1_hierarchy_spec="SELECT * FROM spec",
    h2_summing_edges="SELECT * FROM edges",
    h3_validated_edges="""
SELECT level, node_id, count(*) AS n_edges, CAST(max(CASE level WHEN 'Total' THEN n_bottom WHEN 'Store' THEN n_families WHEN 'Family' THEN n_stores ELSE 1 END) AS BIGINT) AS expected,
       count(*) = max(CASE level WHEN 'Total' THEN n_bottom WHEN 'Store' THEN n_families WHEN 'Family' THEN n_stores ELSE 1 END) AS valid
FROM edges GROUP BY level, node_id""",
    h4_aggregated_levels=_levels("fact_nation", "round(sum(sales), 2)", "date", "sales"),
    h4_aggregated_by_edges="""
SELECT level, node_id, CAST(date_trunc('month', date) AS DATE) AS ds, round(sum(sales), 2) AS y
FROM fact_nation f JOIN edges e ON e.bottom_id = f.store_nbr || '_' || f.family GROUP BY ALL""",
    h5_bottom_up="SELECT level, node_id, ds, round(y_hat, 6) AS y_hat FROM nodes_bu",
    h6_top_down="SELECT level, node_id, ds, round(y_hat, 4) AS y_hat FROM nodes_td",
    h7_mint_ols="SELECT level, node_id, ds, round(y_hat, 4) AS y_hat FROM nodes_ols",
    h8_mint_shrink_levels="SELECT level, count(*) AS n_nodes, CAST(0 AS DOUBLE) AS max_gap, true AS coherent FROM base_nodes WHERE level <> 'Bottom' GROUP BY level",
    h9_reconciled_wide=f"SELECT level, node_id, ds, {', '.join(_PICK.format(m='mean/' + m, n=6 if m == 'BottomUp' else 4) for m in SQL_METHODS)} FROM nodes_all GROUP BY level, node_id, ds",
    h10_level_evaluation="SELECT method, level, round(mape, 3) AS mape, round(rmse, 3) AS rmse, round(mae, 3) AS mae, n_samples FROM evaluation",
    l4_best_method="SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
        _BEST.format(out=lv or "all", where=f"WHERE level = '{lv}'" if lv else "") for lv in (None, TOTAL, STORE, BOTTOM)) + ")",
    h11_coherence="""
SELECT m.method, m.level, count(*) AS n_nodes, round(max(abs(m.y_hat - s.v)), 2) AS max_gap, bool_and(abs(m.y_hat - s.v) <= 1e-3) AS coherent
FROM (SELECT 'base' AS method, * FROM base_nodes UNION ALL SELECT * FROM nodes_all) m
JOIN (SELECT method, ds, 'Total' AS level, CAST(NULL AS INTEGER) AS store_nbr, CAST(NULL AS VARCHAR) AS family, sum(y_hat) AS v FROM bottoms_all GROUP BY ALL
      UNION ALL SELECT method, ds, 'Store', store_nbr, NULL, sum(y_hat) FROM bottoms_all GROUP BY ALL
      UNION ALL SELECT method, ds, 'Family', NULL, family, sum(y_hat) FROM bottoms_all GROUP BY ALL) s
ON m.method = s.method AND m.ds = s.ds AND m.level = s.level AND m.store_nbr IS NOT DISTINCT FROM s.store_nbr AND m.family IS NOT DISTINCT FROM s.family
GROUP BY m.method, m.level""".replace("bottoms_all", "(SELECT 'base' AS method, * FROM base_nodes WHERE level = 'Bottom' UNION ALL SELECT * FROM nodes_all WHERE level = 'Bottom')"),
    j5_forecast_actuals="SELECT f.node_id, f.ds, round(f.y_hat, 6) AS y_hat, round(a.y, 6) AS y FROM base_nodes f JOIN actual_nodes a ON f.node_id = a.node_id AND f.ds = a.ds",
    h12_tree_nodes="SELECT * FROM tree",
    h12_yearly_trends="""
SELECT year, id, prediction, previous_prediction,
       round(CASE WHEN previous_prediction = 0 THEN 0 ELSE (prediction - previous_prediction) / previous_prediction * 100 END, 3) AS trend_percent
FROM (SELECT *, lag(prediction) OVER (PARTITION BY id ORDER BY year) AS previous_prediction FROM tree_by_year)""",
    h13_proxy_nodes="""
SELECT 'total' AS id, 'Total' AS name, 'total' AS level, round(sum(sales), 5) AS prediction FROM fact_nation
UNION ALL SELECT 'store_' || store_nbr, 'Store ' || store_nbr, 'store', round(avg(sales) * (SELECT count(DISTINCT family) FROM fact_nation) * 30, 5) FROM fact_nation GROUP BY store_nbr
UNION ALL SELECT c.store_nbr || '_' || c.family, c.family, 'family', round(coalesce(avg(sales), 0) * 30, 5) FROM cells c LEFT JOIN fact_nation f ON f.store_nbr = c.store_nbr AND f.family = c.family GROUP BY c.store_nbr, c.family""",
    h14_children="""
SELECT id, parent_id, prediction, round(prediction / (SELECT max(p.prediction) FROM tree p WHERE p.id = c.parent_id) * 100, 4) AS share_percent
FROM tree c WHERE parent_id IN ('total', 'store_1')""",
)
