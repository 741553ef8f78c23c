"""Exact top-k inner products by a three-phase uniform threshold over vector segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import table

#: Rows of a block of candidates and of a block of queries that are compared at once.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
BLOCK_KEYS = ("d", "seg", "cb", "qb")
LIST_SCHEMA = "ask long, at long, d int, seg int, cb int, qb int, part long"


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point only where it is exact, by Python integers if 64 bits may not do."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = int(np.abs(q).max()) * int(np.abs(c).max()) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, segments: int = 2, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each query.

    ``vectors`` and ``queries`` have vec_id long and v array<long>, usable and not null; only vectors as long as
    the query's take part. Rows with the query's vec_id are not its candidates, whatever their vectors. Ties go to
    the smaller vec_id. A query row that is repeated, or a vec_id with several vectors, is answered once for each row; a
    candidate row that is repeated is an answer as often as it occurs. Other columns are left out; empty tables give no rows.

    A vector is cut into ``segments``; its score is the sum of the segments' parts. (1) For each query and
    segment, the k highest parts are gathered, and the rows they belong to are scored in full: the k-th best
    of these scores is a cutoff that the true k-th best cannot be below. (2) The cutoff goes to all
    segments with the query, and each gives every row whose part is at least cutoff / segments: a row
    that none of them gives has a sum below the cutoff. (3) What they give is scored in full and ranked.
    This holds for negative parts as well. Parts past 64 bits are held at the ends of that range. Equal vectors are compared once, for the k + 1 smallest vec_ids of
    each: others could not be among k. Queries and candidates meet in pairs of blocks.
    """
    # The limit by row number is taken in each map task before the shuffle, so a hot vector sends k + 1 rows from each.
    same = Window.partitionBy("v").orderBy("vec_id")
    each = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    few = each.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    rows = materialised(few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
                        .withColumn("at", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "candidates")
    asked = materialised(queries.select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("d")), "queries")
    n, m = rows.count(), asked.count()
    cuts, query_cuts = max(1, -(-n // block)), max(1, -(-m // QUERY_BLOCK))

    def segment(v: str) -> Column:
        """Components i, i + segments, … of each segment i: (seg, part of the vector)."""
        width = F.ceil(F.col("d") / F.lit(segments)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.struct(
            s.alias("seg"), F.slice(F.col(v), s * width + 1, F.greatest(width, F.lit(1))).alias("x")))

    left = rows.select("at", "d", F.pmod(F.xxhash64(F.lit(5), "at"), F.lit(cuts)).cast("int").alias("cb"), F.explode(segment("v")).alias("s")) \
        .select("d", "s.seg", "cb", F.explode(F.sequence(F.lit(0), F.lit(query_cuts - 1))).alias("qb"), F.col("at").alias("id"), F.col("s.x").alias("x"))

    def right(frame: DataFrame) -> DataFrame:
        return frame.select("ask", "d", "cut", F.pmod(F.xxhash64(F.lit(6), "ask"), F.lit(query_cuts)).cast("int").alias("qb"), F.explode(segment("q")).alias("s")) \
            .select("d", "s.seg", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cb"), "qb", F.col("ask").alias("id"), F.col("s.x").alias("x"), "cut")

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame, pick) -> pd.DataFrame:
        c, q = _matrix(a["x"]), _matrix(b["x"])
        scores = _scores(q, c)
        i, j = pick(scores, b["cut"].to_numpy()) if scores.size else (np.empty(0, int), np.empty(0, int))
        return _list(key, b["id"].to_numpy()[i], a["id"].to_numpy()[j], scores[i, j])

    def best(scores: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = min(k + 1, scores.shape[1])
        j = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
        return np.repeat(np.arange(len(scores)), wide), j.ravel()

    def enough(scores: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(scores >= cut[:, None])

    def blocks(frame: DataFrame, pick) -> DataFrame:
        return left.groupBy(*BLOCK_KEYS).cogroup(right(frame).groupBy(*BLOCK_KEYS)).applyInPandas(lambda key, a, b: compare(key, a, b, pick), LIST_SCHEMA)

    nothing = asked.withColumn("cut", F.lit(0).cast("long"))

    def lookup(key: tuple, both: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return _list(key, *[np.empty(0, np.int64)] * 3)
        sides = []
        for query, ids in ((False, pairs["at"]), (True, pairs["ask"])):
            own = both[both["query"] == query].sort_values("id")
            sides.append((_matrix(own["x"]), np.searchsorted(own["id"].to_numpy(), ids.to_numpy())))
        (c, j), (q, i) = sides
        part = np.concatenate([_paired(q[i[n:n + 65536]], c[j[n:n + 65536]]) for n in range(0, len(i), 65536)])
        return _list(key, pairs["ask"].to_numpy(), pairs["at"].to_numpy(), part)

    def complete(given: DataFrame) -> DataFrame:
        """(ask, at, score) of all pairs in the lists: the parts that are missing are looked up, block by block."""
        seen = materialised(given.groupBy("ask", "at", "d", "cb", "qb").agg(
            F.sum("part").alias("part"), F.bit_or(F.expr("shiftleft(1L, seg)")).alias("segs")), "seen")
        open_ = F.filter(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.getbit("segs", s) == 0)
        missing = seen.select("ask", "at", "d", F.explode(open_).alias("seg"), "cb", "qb")
        sides = left.withColumn("query", F.lit(False)).unionByName(right(nothing).drop("cut").withColumn("query", F.lit(True)))
        found = sides.groupBy(*BLOCK_KEYS).cogroup(missing.groupBy(*BLOCK_KEYS)).applyInPandas(lookup, LIST_SCHEMA)
        return seen.select("ask", "at", "part").unionByName(found.select("ask", "at", "part")).groupBy("ask", "at").agg(F.sum("part").alias("score"))

    def ranked(totals: DataFrame) -> DataFrame:
        named = totals.join(rows.select("at", "ids"), "at").join(asked.select("ask", "query_id"), "ask")
        each = named.select("ask", "query_id", F.explode("ids").alias("id"), "score").where("query_id <> id.vec_id")
        each = each.select("ask", "query_id", F.col("id.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.least("id.n", F.lit(k)).cast("int"))).alias("copy"), "score")
        order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id", "copy")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    by_part = Window.partitionBy("ask", "seg").orderBy(F.col("part").desc(), "at")
    lists = blocks(nothing, best).withColumn("_n", F.row_number().over(by_part)).where(F.col("_n") <= k + 1).drop("_n")
    first = ranked(complete(lists))
    cutoff = first.groupBy("ask").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    # The greatest integer below low / segments; parts from there on are given, a little more than needed.
    below = F.col("low") - 1
    share = ((below - F.pmod(below, F.lit(segments))) / F.lit(segments)).cast("long")
    # Where fewer than k rows were found, nothing may be left out.
    cut = materialised(asked.join(cutoff, "ask", "left").select(
        "ask", "q", "d", "low", F.coalesce(share, F.lit(-(1 << 63)).cast("long")).alias("cut")), "cutoffs")
    totals = complete(blocks(cut, enough))
    hopeful = totals.join(cut.select("ask", "low"), "ask").where(F.col("low").isNull() | (F.col("score") >= F.col("low")))
    return ranked(hopeful).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), -1) if len(x) else np.empty((0, 0), np.int64)


def _list(key: tuple, query: np.ndarray, at: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    d, seg, cb, qb = (np.int32(x) for x in key)
    return pd.DataFrame({"ask": query, "at": at, "d": d, "seg": seg, "cb": cb, "qb": qb, "part": part})


def _paired(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows at the same place."""
    if q.size and int(np.abs(q).max()) * int(np.abs(c).max()) * q.shape[1] >= 1 << 63:
        return np.clip((q.astype(object) * c.astype(object)).sum(axis=1), -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (q * c).sum(axis=1)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_inner_products(rows, rows.where(F.col("vec_id") % 50 == 0))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS ask, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.ask, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
