"""The trie of shared conversation beginnings, by peeling turns off from the deepest level upward.

A node is a sequence of turns. It is known by the exclusive or of one hash for each of its turns, salted with the
turn's place, in two independent 64-bit halves: an associative identity, so long conversations are cut into bands
of depth and no task needs one whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.stages import materialised, write_stage
from .common import CRC_TABLE, crc32_sql, table
from .ordered import in_order

#: Depths at which bands begin; from the last on, each band has BAND levels.
FLOORS, BAND = (0, 8, 64, 512), 4096
#: Turns of a group that one task peels by itself; larger groups are peeled level by level.
GROUP_TURNS = 65_536
PATH = "array<struct<p1:long,p2:long,bytes:long>>"
NODES = "depth long, p1 long, p2 long, q1 long, q2 long, c long, n long, children long, leaves long, saved long"


def floor_of(band: int) -> int:
    return FLOORS[band] if band < len(FLOORS) else BAND * (band - len(FLOORS) + 1)


def _band(pos: Column) -> Column:
    found = F.floor(pos / BAND).cast("int") + len(FLOORS) - 1
    for band in reversed(range(len(FLOORS))):
        found = F.when(pos < floor_of(band + 1), band).otherwise(found)
    return found


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, i from 0, a, b: two hashes of role and text, bytes) in order, and conversations (c, n).

    The number within a conversation is the distance in the global order from where its part begins, and what
    lies in earlier parts; no conversation is gathered.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    rows = rows.select("c", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64(F.lit(21), "role", "text").alias("a"),
                       F.xxhash64(F.lit(22), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("bytes"))
    by = [F.col(x).asc() for x in ("c", "turn", "role", "head", "a", "b")]
    placed = in_order(rows, by, ["c", "a", "b", "bytes"], "turns")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("c", "part").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    runs = materialised(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    turns = placed.join(runs.select("c", "part", "start", "before"), ["c", "part"]).select(
        "c", "part", (F.col("place") - F.col("start") + F.col("before")).alias("i"), "a", "b", "bytes")
    return turns, runs


def forked(turns: DataFrame, runs: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as forks: the first ``head`` turns of conversation ``base``, then their own behind as many.

    base and head are columns over c, head below 64. Gives turns (c, pos, a, b, bytes) and conversations (c, turns).
    """
    convs = runs.groupBy("c").agg(F.sum("n").alias("n")).withColumn("base", base).withColumn("h", head.cast("long"))
    sizes = convs.select(F.col("c").alias("base"), F.col("n").alias("there"))
    plan = materialised(convs.join(sizes, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))), "forks")
    # The shift goes to the parts of a conversation, so the turns meet it by (conversation, part).
    shift = runs.select("c", "part").join(plan.select("c", "h", "m"), "c")
    own = turns.join(shift, ["c", "part"]).where("i >= h").select("c", (F.col("i") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "bytes")
    heads = turns.where("i < 64").select(F.col("c").alias("base"), F.col("i").alias("pos"), "a", "b", "bytes")
    given = heads.join(plan.select("c", "base", "m"), "base").where("pos < m").select("c", "pos", "a", "b", "bytes")
    return own.unionByName(given), plan.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def segments(turns: DataFrame) -> DataFrame:
    """Conversations by band: (c, band, f1, f2: the node above the band, path: nodes in the band, last: ends here)."""
    hashed = turns.select("c", "pos", "bytes", _band(F.col("pos")).alias("band"), *[F.xxhash64(F.lit(s), "pos", "a", "b").alias(x) for s, x in ((3, "x1"), (4, "x2"))])
    upto = Window.partitionBy("c", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("c", "band", "pos", "bytes", *[F.bit_xor(x).over(upto).alias(r) for x, r in (("x1", "r1"), ("x2", "r2"))])
    own = materialised(inside.groupBy("c", "band").agg(F.array_sort(F.collect_list(F.struct("pos", "r1", "r2", "bytes"))).alias("path")), "segments")
    order = Window.partitionBy("c").orderBy("band")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = own.select("c", "band", *[F.element_at("path", -1)[r].alias(r) for r in ("r1", "r2")])
    ends = ends.select("c", "band", F.lead("band").over(order).isNull().alias("last"),
                       *[F.coalesce(F.bit_xor(r).over(above), F.lit(0)).alias(f) for r, f in (("r1", "f1"), ("r2", "f2"))])
    whole = own.join(ends, ["c", "band"]).withColumn("path", F.transform("path", lambda x: F.struct(
        x["r1"].bitwiseXOR(F.col("f1")).alias("p1"), x["r2"].bitwiseXOR(F.col("f2")).alias("p2"), x["bytes"].alias("bytes"))))
    spark = turns.sparkSession
    return spark.read.schema(f"c long, f1 long, f2 long, last boolean, path {PATH}, band int").parquet(
        write_stage(whole.select("c", "f1", "f2", "last", "path", "band"), scratch_dir(spark, "bands"), ["band"]))


def _peel_levels(rows: DataFrame, low: int) -> list[DataFrame]:
    """Nodes of a band, one written frame a level: merge what ends at the level with what is left of the level below, strip a turn."""
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    found, left = [], None
    for level in range(deepest, 0, -1):
        here = rows.where(F.size("path") == level)
        here = here if left is None else here.unionByName(left)
        at = F.col("path")[level - 1]
        nodes = here.groupBy(at["p1"].alias("p1"), at["p2"].alias("p2")).agg(
            F.min("c").alias("c"), F.first("path").alias("path"), F.first("f1").alias("f1"), F.first("f2").alias("f2"),
            *[F.sum(x).alias(x) for x in ("n", "children", "leaves", "saved")])
        parent = F.col("path")[level - 2] if level > 1 else F.struct(F.col("f1").alias("p1"), F.col("f2").alias("p2"))
        nodes = materialised(nodes.select(
            F.lit(low + level).cast("long").alias("depth"), "p1", "p2", parent["p1"].alias("q1"), parent["p2"].alias("q2"), "c", "n", "children",
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * at["bytes"]).alias("saved"), "f1", "f2", F.slice("path", 1, level - 1).alias("path")), "level")
        left = nodes.select("c", "f1", "f2", "path", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")
        found.append(nodes.drop("f1", "f2", "path"))
    return found


def _peel_group(rows: list[tuple], low: int) -> Iterator[tuple]:
    """The same for one group in memory: rows (c, f1, f2, path, n, children, leaves, saved)."""
    ending: dict[int, list] = {}
    for c, f1, f2, path, *sums in rows:
        ending.setdefault(len(path), []).append((c, path, *sums))
    above, left = (rows[0][1], rows[0][2]), []
    for level in range(max(ending), 0, -1):
        nodes: dict[tuple, list] = {}
        for c, path, *sums in [*ending.get(level, []), *left]:
            node = nodes.get(path[level - 1][:2])
            if node is None:
                nodes[path[level - 1][:2]] = [c, path, *sums]
            else:
                node[0] = min(node[0], c)
                node[2:] = [x + y for x, y in zip(node[2:], sums)]
        left = []
        for at, (c, path, n, children, leaves, saved) in nodes.items():
            leaves, saved = leaves if children else 1, saved + (n - 1) * path[level - 1][2]
            yield low + level, *at, *(path[level - 2][:2] if level > 1 else above), c, n, children, leaves, saved
            left.append((c, path, n, 1, leaves, saved))


def _peel_groups(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    def groups() -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["f1"], r["f2"]) != group[0][1:3]:
                    yield group
                    group = []
                path = [(x["p1"], x["p2"], x["bytes"]) for x in r["path"]]
                group.append((r["c"], r["f1"], r["f2"], path, r["n"], r["children"], r["leaves"], r["saved"]))
        if group:
            yield group

    names = [x.split()[0] for x in NODES.split(", ")]
    held: list[tuple] = []
    for group in groups():
        held += _peel_group(group, low)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


def _peel(parts: DataFrame, group_turns: int) -> list[DataFrame]:
    """All nodes below the root, in frames, from the deepest band up; the last frames hold the first band."""
    found: list[DataFrame] = []
    left = None
    bands = sorted((r["band"] for r in parts.select("band").distinct().collect()), reverse=True)
    for band in bands:
        low, own = floor_of(band), parts.where(F.col("band") == band)
        zero = [F.lit(x).cast("long").alias(n) for n, x in (("n", 1), ("children", 0), ("leaves", 0), ("saved", 0))]
        rows = own.where("last").select("c", "f1", "f2", "path", *zero)
        if left is not None:  # what is left of deeper bands goes on with the path of its first member
            rows = rows.unionByName(left.join(own.select("c", "f1", "f2", "path"), "c").select(*rows.columns))
        if band:
            rows = materialised(rows, "ending")
            sizes = materialised(rows.groupBy("f1", "f2").agg(F.sum(F.size("path")).alias("turns")), "groups")
            small = rows.join(sizes.where(F.col("turns") <= group_turns), ["f1", "f2"], "left_semi").repartition("f1", "f2").sortWithinPartitions("f1", "f2")
            levels = [materialised(small.mapInArrow(lambda batches, low=low: _peel_groups(batches, low), NODES), "peeled")]
            rows = rows.join(sizes.where(F.col("turns") > group_turns), ["f1", "f2"], "left_semi")
        else:
            levels = []
        levels += _peel_levels(materialised(rows, "ending"), low)
        left = levels[0].where(F.col("depth") == low + 1)
        for level in levels[1:]:
            left = left.unionByName(level.where(F.col("depth") == low + 1))
        left = left.select("c", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")
        found += levels
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (p1, p2, c) in order: the digest of each node's comma-joined c, fed number by number."""
    now, digest = None, None
    for batch in batches:
        done = []
        for p1, p2, c in zip(*[batch.column(x).to_pylist() for x in ("p1", "p2", "c")]):
            if now != (p1, p2):
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (p1, p2), hashlib.sha256(str(c).encode())
            else:
                digest.update(b",%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["p1", "p2", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=["p1", "p2", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (c, pos from 0 without gaps, a, b, bytes), a and b two hashes of what the turn says; convs: (c, turns), each c once.
    A conversation without turns is a member of the root alone. No conversations: no rows. Nodes are told apart by 128 bits.

    Bands of depth are peeled from the deepest up. In a band, conversations that share the node above it are a
    group; a group of few turns is peeled in one task, larger ones, and the first band, level by level: what newly
    ends at a level and what is left of the level below are merged by node, combined before the shuffle, and lose
    their last turn. Levels are written, so lineage stays short. The conversations that end in one node pass
    in order through its digest, one number at a time.
    """
    parts = segments(turns)
    empty = convs.where(F.col("turns") == 0).select("c")
    found = _peel(parts, group_turns)
    first = F.lit(1).cast("long")
    root = empty.select("c", first.alias("n"), *[F.lit(0).cast("long").alias(x) for x in ("children", "leaves", "saved")])
    for level in found:
        root = root.unionByName(level.where("depth = 1").select("c", "n", first.alias("children"), "leaves", "saved"))
    root = root.agg(F.min("c").alias("c"), *[F.sum(x).alias(x) for x in ("n", "children", "leaves", "saved")]).where("n > 0").select(
        *[F.lit(x).cast("long").alias(n) for n, x in (("depth", 0), ("p1", 0), ("p2", 0), ("q1", None), ("q2", None))],
        "c", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), "saved")
    nodes = root
    for level in found:
        nodes = nodes.unionByName(level)
    at = F.element_at("path", -1)
    ends = parts.where("last").select(at["p1"].alias("p1"), at["p2"].alias("p2"), "c").unionByName(
        empty.select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "c"))
    ends = ends.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "c").mapInArrow(_digests, "p1 long, p2 long, ends_sha256 string")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c").alias("parent_conv_id"))
    return nodes.join(ends, ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left").select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(turns: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """The trie of the conversations of ``turns`` (conv_id, turn, role, text; other columns are left out), each rebuilt as
    a fork: the first crc32(c) % 9 turns of conversation c - c % 5, then its own turns behind as many.

    c % 5 has the sign of c. Turns go by number, nulls first; ties by role, the text's first 64 characters and its hash. A null
    role or text is empty; rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    rows, runs = numbered(turns)
    forks, convs = forked(rows, runs, F.col("c") - F.col("c") % 5, F.crc32(F.col("c").cast("string").cast("binary")) % 9)
    return prefix_trie(materialised(forks, "forks"), convs, group_turns)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list({{r: coalesce(role, ''), x: coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc_table),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
members AS (SELECT conv_id, turns, turns[:d] AS node, d FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN d = len(turns) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY node, d),
children AS (SELECT node[:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
sized AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * octet_length(encode(n.node[n.d].x)) ELSE 0 END AS own_saved
  FROM nodes n LEFT JOIN children c ON c.node = n.node),
below AS (
  SELECT node[:a] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM sized) GROUP BY 1)
SELECT s.conv_id, s.d AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM sized s JOIN below b ON b.node = s.node LEFT JOIN nodes p ON s.d > 0 AND p.node = s.node[:s.d - 1]"""
