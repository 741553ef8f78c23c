"""The Total → Store → Family → Bottom hierarchy as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BOTTOM, FAMILY, STORE, TOTAL
from ..functions.text import family_node_id, series_id, store_node_id


def node_key(level: Column, store: Column, family: Column) -> Column:
    """``Total``, ``Store_1``, ``Family_X`` or ``1_X``."""
    return (
        F.when(level == TOTAL, F.lit(TOTAL))
        .when(level == STORE, F.concat(F.lit("Store_"), store.cast("string")))
        .when(level == FAMILY, F.concat(F.lit("Family_"), family))
        .when(level == BOTTOM, series_id(store, family))
    )


def dimension_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("store_nbr").alias("n_stores"),
        F.count_distinct("family").alias("n_families"),
        F.count_distinct("store_nbr", "family").alias("n_series"),
    )


def approx_dimension_counts(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    return df.agg(
        F.approx_count_distinct("store_nbr", rsd).alias("n_stores"),
        F.approx_count_distinct("family", rsd).alias("n_families"),
        F.approx_count_distinct(F.struct("store_nbr", "family"), rsd).alias("n_series"),
    )


def hierarchy_spec(df: DataFrame) -> DataFrame:
    """Every store × family combination, stores first, each sorted; with parent labels and counts.

    The product is the result itself. It grows out of the distinct stores by exploding the list of
    families, so no two frames are crossed.
    """
    families = df.agg(F.sort_array(F.collect_set("family"))).scalar()
    stores = df.select("store_nbr").where(F.col("store_nbr").isNotNull()).distinct()
    # One row per store: numbering it as a whole is bounded by the store dimension.
    everything = Window.partitionBy(F.lit(0))
    numbered = stores.withColumns(
        {
            "_store_pos": F.row_number().over(everything.orderBy("store_nbr")) - 1,
            "n_stores": F.count(F.lit(1)).over(everything).cast("int"),
            "_families": families,
        }
    ).withColumn("n_families", F.size("_families"))
    store, family = F.col("store_nbr"), F.col("family")
    return numbered.select("*", F.posexplode("_families").alias("_family_pos", "family")).select(
        (F.col("_store_pos") * F.col("n_families") + F.col("_family_pos")).cast("int").alias("position"),
        series_id(store, family).alias("bottom_id"),
        "store_nbr",
        "family",
        F.lit(TOTAL).alias("total_label"),
        node_key(F.lit(STORE), store, family).alias("store_label"),
        node_key(F.lit(FAMILY), store, family).alias("family_label"),
        "n_stores",
        "n_families",
        (F.col("n_stores") * F.col("n_families")).alias("n_bottom"),
    )


def summing_edges(spec: DataFrame) -> DataFrame:
    """The summing matrix without its zeros: one row per (node, bottom series below it)."""
    ends = F.array(
        F.struct(F.lit(TOTAL).alias("level"), F.col("total_label").alias("node_id")),
        F.struct(F.lit(STORE).alias("level"), F.col("store_label").alias("node_id")),
        F.struct(F.lit(FAMILY).alias("level"), F.col("family_label").alias("node_id")),
        F.struct(F.lit(BOTTOM).alias("level"), F.col("bottom_id").alias("node_id")),
    )
    return spec.withColumn("_end", F.explode(ends)).select(
        "_end.level", "_end.node_id", "bottom_id", "n_stores", "n_families", "n_bottom"
    )


def validate_edges(edges: DataFrame) -> DataFrame:
    """Number of bottom series below each node against what its level calls for."""
    per_node = edges.groupBy("level", "node_id", "n_stores", "n_families", "n_bottom").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("bottom_id").alias("n_children")
    )
    expected = (
        F.when(F.col("level") == TOTAL, F.col("n_bottom"))
        .when(F.col("level") == STORE, F.col("n_families"))
        .when(F.col("level") == FAMILY, F.col("n_stores"))
        .otherwise(1)
    )
    return per_node.select(
        "level", "node_id", "n_edges", expected.cast("long").alias("expected"),
        ((F.col("n_edges") == expected) & (F.col("n_children") == expected)).alias("valid"),
    )


def complete_grid(df: DataFrame, value: str = "sales", date: str = "date") -> DataFrame:
    """Every series on every calendar day between the first and the last, 0 where there is no row."""
    span = df.agg(F.sequence(F.min(date), F.max(date))).scalar()
    cells = hierarchy_spec(df).select("store_nbr", "family", F.explode(span).alias(date))
    return cells.join(df.select("store_nbr", "family", date, value), ["store_nbr", "family", date], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def aggregate_levels(df: DataFrame, value: str = "y", ds: str = "ds") -> DataFrame:
    """Sums for all four levels per period in one aggregation: level, node_id, store_nbr, family, ds, value."""
    store, family = F.col("store_nbr"), F.col("family")
    summed = df.groupingSets(
        [[F.col(ds)], [F.col(ds), store], [F.col(ds), family], [F.col(ds), store, family]], ds, "store_nbr", "family"
    ).agg(F.sum(value).alias(value), F.grouping("store_nbr").alias("_all_stores"), F.grouping("family").alias("_all_families"))
    level = (
        F.when((F.col("_all_stores") == 1) & (F.col("_all_families") == 1), TOTAL)
        .when(F.col("_all_families") == 1, STORE)
        .when(F.col("_all_stores") == 1, FAMILY)
        .otherwise(BOTTOM)
    )
    return summed.select(level.alias("level"), "store_nbr", "family", ds, value).select(
        "level", node_key(F.col("level"), store, family).alias("node_id"), "store_nbr", "family", ds, value
    )


def aggregate_by_edges(df: DataFrame, edges: DataFrame, value: str = "y", ds: str = "ds") -> DataFrame:
    """The same sums for any edge table: the general form, for hierarchies that are not a product."""
    return (
        df.select(F.col("unique_id").alias("bottom_id"), ds, value)
        .join(edges.select("level", "node_id", "bottom_id"), "bottom_id")
        .groupBy("level", "node_id", ds)
        .agg(F.sum(value).alias(value))
    )


_TREE_LEVEL = {TOTAL: "total", STORE: "store", FAMILY: "family"}


def tree_nodes(df: DataFrame, value: str = "sales", by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of the display tree Total → Store → family of a store: id, name, level, parent_id, prediction.

    Values are sums, so every node equals the sum of its children; families a store lacks are 0.
    ``by`` adds period columns.
    """
    sums = df.groupBy(*by, "store_nbr", "family").agg(F.sum(value).alias("prediction"))
    spec = hierarchy_spec(df).select("store_nbr", "family")
    if not by:
        leaves = spec.join(sums, ["store_nbr", "family"], "left")
    else:
        periods = df.agg(F.collect_set(F.struct(*by))).scalar()
        leaves = spec.withColumn("_p", F.explode(periods)).select("store_nbr", "family", "_p.*").join(
            sums, [*by, "store_nbr", "family"], "left"
        )
    leaves = leaves.withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))
    store, family = F.col("store_nbr"), F.col("family")
    rolled = leaves.groupingSets(
        [[F.col(b) for b in by], [*[F.col(b) for b in by], store], [*[F.col(b) for b in by], store, family]],
        *by, "store_nbr", "family",
    ).agg(F.sum("prediction").alias("prediction"), F.grouping("store_nbr").alias("_g1"), F.grouping("family").alias("_g2"))
    is_total, is_store = F.col("_g1") == 1, (F.col("_g1") == 0) & (F.col("_g2") == 1)

    def pick(total: Column, store_: Column, leaf: Column) -> Column:
        return F.when(is_total, total).when(is_store, store_).otherwise(leaf)

    return rolled.select(
        *by,
        pick(F.lit("total"), store_node_id(store), family_node_id(store, family)).alias("id"),
        pick(F.lit(TOTAL), F.concat(F.lit("Store "), store.cast("string")), family).alias("name"),
        pick(F.lit("total"), F.lit("store"), F.lit("family")).alias("level"),
        pick(F.lit(None), F.lit("total"), store_node_id(store)).alias("parent_id"),
        "store_nbr",
        "prediction",
    )


def proxy_nodes(df: DataFrame, days: int = 30, value: str = "sales") -> DataFrame:
    """The display tree with mean-based values instead: a named variant, not coherent by construction.

    total = plain sum, store = mean × number of families × days, family of a store = mean × days.
    """
    spec = hierarchy_spec(df)
    leaves = df.groupBy("store_nbr", "family").agg(F.avg(value).alias("_mean"))
    stores = df.groupBy("store_nbr").agg(F.avg(value).alias("_mean"))
    total = df.agg(F.sum(value).alias("prediction"))
    n_families = df.agg(F.count_distinct("family")).scalar()
    store, family = F.col("store_nbr"), F.col("family")
    top = total.select(F.lit("total").alias("id"), F.lit(TOTAL).alias("name"), F.lit("total").alias("level"), "prediction")
    mid = stores.withColumn("_n", n_families).select(
        store_node_id(store).alias("id"),
        F.concat(F.lit("Store "), store.cast("string")).alias("name"),
        F.lit("store").alias("level"),
        (F.col("_mean") * F.col("_n") * days).alias("prediction"),
    )
    low = spec.join(leaves, ["store_nbr", "family"], "left").select(
        family_node_id(store, family).alias("id"),
        family.alias("name"),
        F.lit("family").alias("level"),
        (F.coalesce("_mean", F.lit(0.0)) * days).alias("prediction"),
    )
    return top.unionByName(mid).unionByName(low)


def store_trees(nodes: DataFrame) -> DataFrame:
    """One nested row per store: its families in order of name as ``children``."""
    child = F.struct("name", "id", "level", "prediction")
    below = nodes.where(F.col("level") == "family").groupBy(F.col("parent_id").alias("id")).agg(
        F.sort_array(F.collect_list(child)).alias("children")
    )
    return nodes.where(F.col("level") == "store").join(below, "id", "left").select(
        "store_nbr", "id", "name", "level", "prediction", "children"
    )


def tree_document(nodes: DataFrame) -> DataFrame:
    """The whole tree as one nested row. It is one document, as large as the store × family dimension."""
    inner = store_trees(nodes).agg(
        F.sort_array(F.collect_list(F.struct("store_nbr", "id", "name", "level", "prediction", "children"))).alias("children")
    ).select("children").scalar()
    top = nodes.where(F.col("level") == "total").select("id", "name", "level", "prediction")
    return top.withColumn("children", inner)


def children(nodes: DataFrame, parent_id: str) -> DataFrame:
    """Children of one node with their share of the node's value in percent."""
    base = nodes.where(F.col("id") == parent_id).agg(F.max("prediction")).scalar()
    share = F.try_divide(F.col("prediction"), F.nullif("_base", F.lit(0.0))) * 100
    return nodes.where(F.col("parent_id") == parent_id).withColumn("_base", base).withColumn("share_percent", share).drop("_base")


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or id contains the text, in any case; a blank text keeps all."""
    if not query.strip():
        return nodes
    q = F.lower(F.lit(query))
    return nodes.where(F.contains(F.lower("name"), q) | F.contains(F.lower("id"), q))
