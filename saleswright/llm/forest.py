"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import local_roots, smallest_reachable, table
from .topk import usable

#: Most vectors that the trees are fitted on; all vectors are indexed.
SAMPLE_ROWS = 32_768
TREES = 8
#: Share of a node's vectors, around its threshold, that go to both children.
SPILL = 0.16
#: A leaf should hold about so many vectors; one with more than twice as many is compared in pairs of blocks.
LEAF_ROWS = 1024
#: Fewest sampled vectors of a leaf: with them, size of the sample bounds the number of leaves and the broadcast.
LEAF_SAMPLE = 8
#: A node's close pairs are counted among so many of its sampled vectors; with fewer such pairs than this no heap is seen.
PROBES = 512
PROBE_PAIRS = 64
#: A split should part at most this share of the close pairs; where none does and so many of all pairs are close, the branch ends.
PARTED = 0.05
HEAP = 0.25
#: So many directions are tried where a node has a heap.
TRIES = 8


@dataclass
class Tree:
    """Node i: direction[i]; children left[i], right[i], or leaf number -1 - child where negative."""

    direction: np.ndarray
    low: np.ndarray  # projections below go left
    high: np.ndarray  # projections from here on go right; both from low to high
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaves_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every row."""
        found_rows, found = [], []
        todo = [(0 if len(self.left) else -1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                found_rows.append(at)
                found.append(np.full(len(at), -1 - node))
                continue
            x = rows[at] @ self.direction[node]
            todo.append((int(self.left[node]), at[x < self.high[node]]))
            todo.append((int(self.right[node]), at[x >= self.low[node]]))
        return np.concatenate(found_rows), np.concatenate(found)


def _close_pairs(rows: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.triu(rows @ rows.T >= cosine, 1))


def grow(sample: np.ndarray, leaf: int, seed: int, spill: float = SPILL, cosine: float = 0.95) -> Tree:
    """Splits the sample (unit rows) at the median along random directions until at most ``leaf`` rows are left.

    A split whose two sides would not both be clearly smaller ends the branch. Where a large part of a node is close
    (a heap of vectors at ``cosine`` or more, seen in a probe of the node), several directions and thresholds are tried and the one
    that parts the fewest close pairs is taken; if the node is mostly one heap, which any split would cut, the
    branch ends. Such a leaf is compared whole, in blocks.
    """
    draw = np.random.default_rng(seed)
    direction, low, high, left, right = [], [], [], [], []
    leaves = 0

    def leaf_number() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    todo = [(np.arange(len(sample)), None)]
    while todo:
        at, place = todo.pop()
        child = None
        if len(at) > leaf:
            probe = at[np.linspace(0, len(at) - 1, min(len(at), PROBES)).astype(int)]
            one, two = _close_pairs(sample[probe], cosine)
            heap = len(one) >= PROBE_PAIRS
            best = None
            for _ in range(TRIES if heap else 1):
                u = draw.standard_normal(sample.shape[1])
                u /= np.linalg.norm(u) or 1
                x, y = sample[at] @ u, sample[probe] @ u
                for middle in (0.5, 0.4, 0.6, 0.3, 0.7) if heap else (0.5,):
                    a, b = np.quantile(x, [middle - spill / 2, middle + spill / 2])
                    if max((x < b).sum(), (x >= a).sum()) <= 0.8 * len(at) and b - a < 0.3:
                        under, over = np.minimum(y[one], y[two]) < a, np.maximum(y[one], y[two]) >= b
                        parted = (under & over).mean() if heap else 0.0
                        if best is None or parted < best[0]:
                            best = parted, u, a, b, at[x < b], at[x >= a]
                if best and best[0] == 0:
                    break
            whole = heap and best and best[0] > PARTED and len(one) >= HEAP * len(probe) * (len(probe) - 1) / 2
            if best and not whole:
                _, u, a, b, go_left, go_right = best
                child = len(direction)
                direction.append(u)
                low.append(a)
                high.append(b)
                left.append(0)
                right.append(0)
                todo += [(go_left, (left, child)), (go_right, (right, child))]
        if child is None:
            child = leaf_number()
        if place:
            place[0][place[1]] = child
    stacked = np.stack(direction) if direction else np.empty((0, sample.shape[1]))
    return Tree(stacked, np.array(low), np.array(high), np.array(left, int), np.array(right, int), leaves)


def _compared(dealt: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) for all pairs inside each (leaf, i, j) that have not met in an earlier leaf."""

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaf_here, i, j = key
        group = group.sort_values("id", ignore_index=True)
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        rows = np.array(group["v"].tolist(), float).reshape(len(ids), -1)
        norm = np.sqrt((rows * rows).sum(axis=1))
        earlier = group["leaves"].explode().astype(np.int64)
        earlier = earlier[earlier < leaf_here]
        names, column = np.unique(earlier.to_numpy(), return_inverse=True)
        member = np.zeros((len(ids), len(names)), bool)
        member[earlier.index.to_numpy(), column] = True
        bits = np.packbits(member, axis=1)
        own = group["own"].to_numpy()
        links, ends = np.zeros(len(ids), np.int64), []
        for at in range(0, len(ids), 512):
            part = slice(at, at + 512)
            close = (rows[part] @ rows.T) / np.outer(norm[part], norm) >= cosine
            if i != j:
                close &= own[part, None] != own[None, :]
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
            # Only close pairs are asked whether they met in an earlier leaf; where most are close, by a product of the lists.
            if np.count_nonzero(close) > close.size / 16:
                close &= member[part].astype(np.float32) @ member.T.astype(np.float32) == 0
            else:
                a, b = np.nonzero(close)
                met = np.concatenate([np.zeros(0, bool), *[(bits[a[n:n + 8192] + at] & bits[b[n:n + 8192]]).any(axis=1) for n in range(0, len(a), 8192)]])
                close[a[met], b[met]] = False
            links[part] = close @ copies
            a, b = np.nonzero(close)
            later = b > a + at
            ends.append(np.stack([a[later] + at, b[later]]))
        a, b = np.concatenate(ends, axis=1)
        root = local_roots(len(ids), a, b)
        has = links > 0
        return pd.DataFrame({"id": ids[has], "links": links[has], "root": ids[root[has]]})

    return dealt.groupBy("leaf", "i", "j").applyInPandas(compare, "id long, links long, root long")


def few_links(vectors: DataFrame, cosine: float) -> DataFrame:
    """As :func:`forest_links`, for vectors of any lengths of which few are of one length: each length is a leaf, without trees."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("i", "j", "own")]
    return _compared(vectors.select(F.size("v").cast("long").alias("leaf"), *zero, "id", "copies", F.array(F.size("v")).alias("leaves"), "v"), cosine)


def forest_links(vectors: DataFrame, cosine: float = 0.95, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    """(id, links, root) for distinct vectors (id long, v array<double>, copies long) of one length that are close.

    links: how many rows the linked other vectors stand for; root: a smaller linked id of the same group, or itself.
    Each id can come several times: links add up, roots connect.

    The trees are fitted on a sample of at most about ``sample_rows`` vectors (by a hash of the id) in the driver
    and broadcast; their size is bounded by the sample's. Every vector goes down all trees, near a threshold
    to both sides, and is compared with all others in its leaves in double precision. A pair that shares several leaves is
    counted in the first of them only: each row carries the list of its leaves. Sizes of all leaves (as many
    numbers as the forest has leaves) are counted first; a leaf beyond twice ``LEAF_ROWS`` is dealt into blocks and each pair of
    blocks is its own group, so that no pair of a leaf is lost and no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    sampled = vectors.where(draw < F.lit(min(1.0, sample_rows / max(n, 1)))).orderBy("id").select("v").toPandas()["v"]
    sample = np.array(sampled.tolist(), float).reshape(len(sampled), -1)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    leaf = max(LEAF_SAMPLE, round(LEAF_ROWS * min(1.0, sample_rows / max(n, 1))))
    built = [grow(sample, leaf, seed + i, cosine=cosine) for i in range(trees)] if len(sample) else [Tree(np.empty((0, 0)), *[np.empty(0)] * 4, 1)]
    built = next(([t] for t in built if t.leaves == 1), built)  # a tree of one leaf compares all pairs
    first = np.cumsum([0, *[t.leaves for t in built]])
    shared = spark.sparkContext.broadcast((built, first))

    def placed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf over all trees), in order of row and leaf."""
        forest, starts = shared.value
        unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        both = [t.leaves_of(unit) for t in forest]
        row, where = np.concatenate([r for r, _ in both]), np.concatenate([x + starts[i] for i, (_, x) in enumerate(both)])
        order = np.lexsort((where, row))
        return row[order], where[order]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column("v")
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def count(batches):
        total = np.zeros(shared.value[1][-1], np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(placed(matrix(batch))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["leaf", "n"])

    sizes = np.zeros(first[-1], np.int64)
    for r in vectors.select("v").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    parts = np.where(sizes > 2 * LEAF_ROWS, -(-sizes // LEAF_ROWS), 1)
    cut = spark.sparkContext.broadcast(parts)

    def deal(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                row, where = placed(matrix(batch))
                ids = batch.column("id").to_numpy()
                own = (ids[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut.value[where]
                repeat = cut.value[where]
                at = np.repeat(np.arange(len(row)), repeat)
                other = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                mine = own[at]
                starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
                leaves = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(where.astype(np.int32)))
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([
                    pa.array(where[at].astype(np.int64)), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine),
                    batch.column("id").take(take), batch.column("copies").take(take), leaves.take(take), batch.column("v").take(take)],
                    names=["leaf", "i", "j", "own", "id", "copies", "leaves", "v"])

    dealt = vectors.select("id", "copies", "v").mapInArrow(
        deal, "leaf long, i long, j long, own long, id long, copies long, leaves array<int>, v array<double>")

    return _compared(dealt, cosine)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, **forest) -> DataFrame:
    """One row (key, n_links, component_id, kept) for each row of ``df``.

    Vectors of one length link at ``cosine`` or more; those of different lengths do not compare. A vector that is null, empty, zero, or has null
    or non-finite components links with nothing, nor does a row with a null key: its n_links is 0 and its
    component its own key. Finite vectors of any length count. Equal vectors are one node that stands for all of them, so copies cost nothing.
    kept: the key is that of its component. Other columns are left out. An empty table gives no rows.
    """
    double = F.transform(vector, lambda x: x.cast("double"))
    given = df.select(F.col(key).cast("long").alias("key"), F.when(F.col(key).isNotNull() & usable(F.col(vector)), double).alias("v"))
    most = given.withColumn("most", F.array_max(F.transform("v", F.abs)))
    # Squares of extreme components would leave the range of doubles: such vectors are scaled, which no cosine notices.
    scaled = F.when(F.col("most").between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("most")))
    rows = most.select("key", F.when(F.col("most") > 0, scaled).alias("v"))
    distinct = materialised(
        rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("key").alias("value"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = distinct.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    many = [r["length"] for r in sizes.where(F.col("n") > 2 * LEAF_ROWS).collect()]  # at most one in 2 x LEAF_ROWS vectors
    found = few_links(distinct.where(~F.size("v").isin(many)), cosine)
    for length in many:
        found = found.unionByName(forest_links(distinct.where(F.size("v") == length), cosine, **forest))
    found = materialised(found, "close")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = smallest_reachable(distinct.select("id", "value"), found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    nodes = materialised(
        distinct.join(links, "id", "left").join(reached.select("id", "component"), "id")
        .select("v", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "nodes")
    out = rows.join(nodes.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left").select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id"""
