"""Nearest neighbours by inner product: vantage-point trees per shard, pruned by a relaxed triangle inequality.

Inner products become distances: a point x gets a further coordinate sqrt(M^2 - |x|^2), M the longest length of
its shard, and a query gets zero there. Then |x' - q'|^2 = M^2 + |q|^2 - 2 x.q, so the nearest point is that of
the largest inner product, and the triangle inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import table
from .topk import usable

#: Bytes of the vectors of a shard, rows of a leaf, queries of a block.
SHARD_BYTES = 8 << 20
LEAF = 256
QUERY_BLOCK = 2048
#: Vantage points tried at a node, and points that they are tried on.
TRIED, TRIED_ON = 8, 256
#: Shards that a block of queries has seen grow by this factor from round to round.
ROUND = 4
NODE = np.dtype([("point", "<i8"), ("in_low", "<f8"), ("in_high", "<f8"), ("out_low", "<f8"), ("out_high", "<f8"),
                 ("inside", "<i8"), ("outside", "<i8"), ("start", "<i8"), ("end", "<i8")])
INDEX = "d int, shard int, points binary, at binary, first binary, second binary, nodes binary"
FOUND = "ask long, at long, score double"
#: A row with one vec_id has this for the second.
NONE = np.iinfo(np.int64).max


def _grow(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a tree over the points, and the points' order in which each node is a range."""
    square = (points * points).sum(axis=1)
    lifted = np.column_stack([points, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))])
    draw = np.random.default_rng(len(points))
    order, nodes = np.arange(len(points)), []
    waiting = [(0, len(points), -1, "")]
    while waiting:
        start, end, parent, side = waiting.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        node = {"point": -1, "start": start, "end": end}
        nodes.append(node)
        own = order[start:end]
        if len(own) <= leaf:
            continue
        on = lifted[draw.choice(own, min(TRIED_ON, len(own)), replace=False)]
        tried = draw.choice(own, min(TRIED, len(own)), replace=False)
        spread = [np.std(np.sqrt(((on - lifted[p]) ** 2).sum(axis=1))) for p in tried]
        point = int(tried[int(np.argmax(spread))])
        away = np.sqrt(((lifted[own] - lifted[point]) ** 2).sum(axis=1))
        by = np.argsort(away, kind="stable")
        half = len(own) // 2
        order[start:end], away = own[by], away[by]
        node |= {"point": point, "in_low": away[0], "in_high": away[half - 1], "out_low": away[half], "out_high": away[-1]}
        waiting += [(start + half, end, len(nodes) - 1, "outside"), (start, start + half, len(nodes) - 1, "inside")]
    packed = np.zeros(len(nodes), NODE)
    for i, node in enumerate(nodes):
        for k, v in node.items():
            packed[i][k] = v
    # Points are kept in the tree's order, so a leaf is a slice.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    inner = packed["point"] >= 0
    packed["point"][inner] = place[packed["point"][inner]]
    return packed, order


class Tree:
    """A shard's tree; answers blocks of queries."""

    def __init__(self, row: dict) -> None:
        self.nodes = np.frombuffer(row["nodes"], NODE)
        self.at, self.first, self.second = (np.frombuffer(row[c], "<i8") for c in ("at", "first", "second"))
        self.points = np.frombuffer(row["points"], "<f8").reshape(len(self.at), row["d"])
        self.longest = float((self.points * self.points).sum(axis=1).max(initial=0.0))
        self.compared = 0

    def search(self, asked: np.ndarray, ids: np.ndarray, cut: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of each query that are not below its cut.

        A subtree is left out for a query if factor times its least distance is above that of the k-th best."""
        m, d = asked.shape
        self.asked, self.ids, self.k, self.factor = asked, ids, k, factor
        self.own = (asked * asked).sum(axis=1)
        self.slack = 4 * (d + 2) * np.finfo(float).eps * np.sqrt(self.own * self.longest)
        self.blur = 1e-7 * (np.sqrt(self.own) + np.sqrt(self.longest))
        self.score = np.full((m, k), -np.inf)
        self.row = np.full((m, k), -1, np.int64)
        self.least = np.full((m, k), NONE)
        self.cut = cut.copy()
        self.home = np.full(m, -1, np.int64)
        if m and len(self.at):
            self._go_home(0, np.arange(m))
            self._descend(0, np.arange(m))
        i, j = np.nonzero(self.row >= 0)
        return i, self.row[i, j], self.score[i, j]

    def _away(self, point: int, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest + self.own[who] - 2 * (self.asked[who] @ self.points[point]), 0))

    def _go_home(self, at: int, who: np.ndarray) -> None:
        """Every query first sees the leaf that it would itself lie in."""
        node = self.nodes[at]
        if node["point"] < 0:
            self.home[who] = at
            self._compare(node, who)
            return
        near = self._away(node["point"], who) <= (node["in_high"] + node["out_low"]) / 2
        for side, part in (("inside", who[near]), ("outside", who[~near])):
            if len(part):
                self._go_home(int(node[side]), part)

    def _descend(self, at: int, who: np.ndarray) -> None:
        node = self.nodes[at]
        if node["point"] < 0:
            self._compare(node, who[self.home[who] != at])
            return
        away = self._away(node["point"], who)
        for side, low, high in (("inside", "in_low", "in_high"), ("outside", "out_low", "out_high")):
            least = np.maximum(np.maximum(away - node[high], node[low] - away) - self.blur[who], 0)
            reach = np.sqrt(np.maximum(self.longest + self.own[who] - 2 * self.cut[who], 0)) + self.blur[who]
            left = self.factor * least <= reach
            if left.any():
                self._descend(int(node[side]), who[left])

    def _compare(self, node: np.void, who: np.ndarray) -> None:
        if not len(who):
            return
        start, end = int(node["start"]), int(node["end"])
        self.compared += len(who) * (end - start)
        rough = self.asked[who] @ self.points[start:end].T
        i, j = np.nonzero(rough >= (self.cut[who] - self.slack[who])[:, None])
        j += start
        # A row that only the query itself has is no candidate.
        other = (self.second[j] != NONE) | (self.first[j] != self.ids[who[i]])
        i, j = i[other], j[other]
        if not len(i):
            return
        score = np.concatenate([_in_order(self.asked[who[i[n:n + 65536]]], self.points[j[n:n + 65536]]) for n in range(0, len(i), 65536)])
        least = np.where(self.first[j] == self.ids[who[i]], self.second[j], self.first[j])
        hit = np.unique(i)
        held = np.repeat(hit, self.k)
        i = np.concatenate([held, i])
        score = np.concatenate([self.score[who[hit]].ravel(), score])
        j = np.concatenate([self.row[who[hit]].ravel(), j])
        least = np.concatenate([self.least[who[hit]].ravel(), least])
        by = np.lexsort((least, -score, i))
        i, score, j, least = i[by], score[by], j[by], least[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        to, rank = who[i[top]], rank[top]
        self.score[to, rank], self.row[to, rank], self.least[to, rank] = score[top], j[top], least[top]
        self.cut[who[hit]] = np.maximum(self.cut[who[hit]], self.score[who[hit], self.k - 1])


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows at the same place, added up from the first component to the last."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


def build(vectors: DataFrame, shard_bytes: int = SHARD_BYTES, leaf: int = LEAF, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """An index of ``vectors`` (vec_id long, v array<double>, usable): its trees, one row a shard, and its rows.

    Equal vectors are one row with the k + 1 smallest of their vec_ids and how often each occurs; more could not be
    among k answers. Shards are drawn by hash, each of one length of vectors and about ``shard_bytes``, so a crowd
    of close vectors is spread. Both tables are written.
    """
    # The limit by row number is taken in each map task before the shuffle, so a hot vector sends k + 1 rows from each.
    each = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    few = each.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    rows = materialised(few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
                        .withColumn("at", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vectors")
    total = rows.agg(F.coalesce(F.sum(F.greatest("d", F.lit(1))), F.lit(0))).first()[0] * 8
    shards = max(1, -(-total // shard_bytes))

    def plant(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        points = np.array(own["v"].tolist(), "<f8").reshape(len(own), -1)
        nodes, order = _grow(points, leaf)
        own, points = own.iloc[order], points[order]
        return pd.DataFrame([{"d": key[0], "shard": key[1], "points": points.tobytes(), "nodes": nodes.tobytes(),
                              **{c: own[c].to_numpy("<i8").tobytes() for c in ("at", "first", "second")}}])

    dealt = rows.select("d", F.pmod(F.xxhash64(F.lit(12), "at"), F.lit(shards)).cast("int").alias("shard"), "at", "v",
                        F.col("ids")[0]["vec_id"].alias("first"), F.coalesce(F.get("ids", F.lit(1))["vec_id"], F.lit(int(NONE))).alias("second"))
    return materialised(dealt.groupBy("d", "shard").applyInPandas(plant, INDEX), "trees"), rows


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_bytes: int = SHARD_BYTES,
            leaf: int = LEAF, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row of ``queries``.

    Both frames have vec_id long and v array<double>, usable. Rows with the query's vec_id are not its candidates;
    rows of other lengths neither. A repeated query row is answered as often as it is asked; a repeated row is an
    answer as often as it occurs. Ties go to the smaller vec_id; fewer candidates than k are all given; empty tables
    give no rows. The score adds up the products in double precision from the first component to the last.

    factor: a subtree is left out if ``factor`` times the least distance that the triangle inequality allows it is above that
    of the k-th best so far. 1 gives the exact answer; more is faster and may miss.

    A block of queries goes through the shards in rounds, from shards of its own on, 1, then 3, 12, ... of them:
    its k-th best scores go with it, so later shards give out few rows. A task has one tree in memory and reads
    the blocks of queries one by one.
    """
    trees, rows = build(vectors, shard_bytes, leaf, k)
    shards = (trees.agg(F.max("shard")).first()[0] or 0) + 1
    asked = materialised(queries.select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("query_id"), "v", F.size("v").alias("d")), "asked")
    m = asked.count()
    blocks = max(1, -(-m // block), min(shards, -(-m // 64)))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64(F.lit(13), "ask"), F.lit(blocks)).cast("int"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["asked"] is None:
                    tree = Tree(row)
                    continue
                block = row["asked"]
                q = np.array([a["v"] for a in block], "<f8").reshape(len(block), -1)
                ids = np.array([a["query_id"] for a in block], np.int64)
                cut = np.array([a["cut"] for a in block], float)
                i, j, score = tree.search(q, ids, cut, k, factor)
                ask = np.array([a["ask"] for a in block], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ask[i]), pa.array(tree.at[j]), pa.array(score)], names=["ask", "at", "score"])

    best, seen = None, 0
    while seen < shards:
        upto = min(shards, max(1, seen * ROUND))
        now = asked.withColumn("cut", F.lit(float("-inf"))) if best is None else asked.join(
            best.groupBy("ask").agg(F.when(F.sum("n") >= k, F.min("score")).alias("cut")), "ask", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))
        packed = now.groupBy("d", "qb").agg(F.collect_list(F.struct("ask", "query_id", "v", "cut")).alias("asked"))
        visits = packed.select("d", "qb", "asked", F.explode(F.sequence(F.lit(seen), F.lit(upto - 1))).alias("step"))
        visits = visits.withColumn("shard", F.pmod(F.col("qb") + F.col("step"), F.lit(shards)).cast("int")).drop("step")
        there = visits.join(trees.select("d", "shard"), ["d", "shard"], "left_semi")
        both = trees.unionByName(there, allowMissingColumns=True).repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", F.col("qb").asc_nulls_first())
        found = both.mapInArrow(answer, FOUND)
        best = materialised(_ranked(found if best is None else found.unionByName(best.select("ask", "at", "score")), asked, rows, k), "nearest")
        seen = upto
    told = best.select("ask", "query_id", "score", F.explode("ids").alias("id"))
    told = told.select("ask", "query_id", F.col("id.vec_id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.least("id.n", F.lit(k)).cast("int"))).alias("copy"))
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id", "copy")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with the vec_ids they stand for, the query's own left out, and their number."""
    named = found.join(rows.select("at", "ids"), "at").join(asked.select("ask", "query_id"), "ask")
    named = named.withColumn("ids", F.filter("ids", lambda x: x["vec_id"] != F.col("query_id")))
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("ids")[0]["vec_id"])
    best = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return best.withColumn("n", F.lit(1))


#: Relaxation of the registered query.
FACTOR = 1.0


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (double) of the rows that take part: not null, finite, and not zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", v.alias("v")).where(F.exists("v", lambda x: x != 0))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), factor=FACTOR)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS ask, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.ask, q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
