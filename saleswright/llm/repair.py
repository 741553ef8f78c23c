"""Cheapest repair of the structure of conversations, by Four-Russians tables over blocks of rows.

A conversation is a string of row symbols. What is left to pay from a row on depends on the roles given out so
far only through four states, so it is a vector of four costs; without its least value it is one of a few vectors.
A table says for each vector and each block of ``BLOCK`` symbols which vector stands before the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import CRC_TABLE, crc32_sql, table
from .ordered import in_order, turn_order

#: Symbols of a block; the table has 10 ** BLOCK columns.
BLOCK = 4
#: Rows by first letter of the role (system, user, assistant, other), large letters for truncated rows; ``d``
#: must go, ``-`` is no row. Blank rows are written ``b`` and repeated ones ``d``; both must go.
SYMBOLS = "-dsSuUaAoO"
_CODE = np.zeros(128, np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
_CODE[ord("b")] = SYMBOLS.index("d")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, a system turn, a user turn, a finished pair. Where a further user or assistant turn leads.
NEXT = (2, 2, 3, 2)
GIVEN = ("user", "user", "assistant", "user")
#: Where a kept role leads, by state; None: not allowed there.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
#: Costs and edits after the last row.
LAST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
FAR = 1 << 30


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a row: (letter, cost, next state)."""
    if symbol == "-":
        return [("", 0, state)]
    found = [("D", DELETE, state)]
    if symbol != "d":
        more = TRUNCATED * symbol.isupper()
        kept = KEPT[symbol.lower()][state]
        if kept is not None:
            found.append(("K", more, kept))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


def _before(after: tuple[int, ...], symbol: str) -> list[int]:
    """Costs from before a row on, given those from behind it on."""
    if symbol == "-":
        return list(after)
    own = [min(cost + after[to] for _, cost, to in _edits(symbol, q)) for q in range(4)]
    # An insertion leads to state 2 or 3; two in a row lead back, so one round settles those states.
    own[2], own[3] = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return [min(own[q], INSERT + own[2]) if q < 2 else own[q] for q in range(4)]


class Tables:
    """Vectors that occur, transitions by symbol and by block, and the least edits of each step."""

    def __init__(self) -> None:
        self.vectors = [LAST]
        at = {LAST: 0}
        moves: list[list[tuple[int, int]]] = []
        for vector in self.vectors:
            row = []
            for symbol in SYMBOLS:
                costs = _before(vector, symbol)
                low = min(costs)
                new = tuple(c - low for c in costs)
                if new not in at:
                    at[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((at[new], low))
            moves.append(row)
        n, k = len(self.vectors), len(SYMBOLS)
        self.to = np.array([[m[0] for m in row] for row in moves], np.int64)
        self.paid = np.array([[m[1] for m in row] for row in moves], np.int64)
        self.block_to, self.block_paid = np.arange(n)[:, None], np.zeros((n, 1), np.int64)
        for _ in range(BLOCK):  # one more symbol in front of each shorter block
            to, paid = self.to[self.block_to], self.paid[self.block_to] + self.block_paid[:, :, None]
            self.block_to = to.transpose(0, 2, 1).reshape(n, -1)
            self.block_paid = paid.transpose(0, 2, 1).reshape(n, -1)
        self.step = [[[self._least(v, q, s) for s in SYMBOLS] for q in range(4)] for v in self.vectors]
        self.radix = k ** np.arange(BLOCK - 1, -1, -1)
        self.walk_block = lru_cache(1 << 16)(self._walk_block)

    def _least(self, after: tuple[int, ...], state: int, symbol: str) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits up to and with a row, and the state behind them."""
        costs = _before(after, symbol)
        letters = ""
        while True:
            for letter, cost, to in sorted([*_edits(symbol, state), *([("I", FAR, 0)] if symbol != "-" else [])]):
                if letter == "I":
                    if INSERT + costs[NEXT[state]] == costs[state]:
                        letters, state = letters + "I", NEXT[state]
                        break
                elif cost + after[to] == costs[state]:
                    return letters + letter, to

    def blocks(self, symbols: str) -> np.ndarray:
        """Block numbers of a run; the last block is filled up with no rows."""
        codes = _CODE[np.frombuffer(symbols.encode(), np.uint8)].astype(np.int64)
        return np.pad(codes, (0, -len(codes) % BLOCK)).reshape(-1, BLOCK) @ self.radix

    def across(self, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind a run: the vector before it, and what is paid between."""
        at, paid = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for block in self.blocks(symbols)[::-1].tolist():
            paid += self.block_paid[at, block]
            at = self.block_to[at, block]
        return at, paid

    def _walk_block(self, right: int, state: int, block: int) -> tuple[str, int]:
        """Edits of a block: its inner vectors are expanded backward from its right border, then it is walked forward."""
        codes = [block // r % len(SYMBOLS) for r in self.radix.tolist()]
        behind = [right]
        for c in codes[:0:-1]:
            behind.append(int(self.to[behind[-1], c]))
        letters = []
        for c, v in zip(codes, behind[::-1]):
            more, state = self.step[v][state][c]
            letters.append(more)
        return "".join(letters), state

    def walk(self, symbols: str, right: int, states: list[int]) -> list[tuple[str, int]]:
        """The ASCII-least cheapest edits of a run from each state before it: (letters, state behind)."""
        blocks = self.blocks(symbols).tolist()
        borders = [right]
        for block in blocks[:0:-1]:
            borders.append(int(self.block_to[borders[-1], block]))
        out = []
        for state in states:
            letters = []
            for block, v in zip(blocks, reversed(borders)):
                more, state = self.walk_block(v, state, block)
                letters.append(more)
            out.append(("".join(letters), state))
        return out


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's transition of all vectors, as bytes."""
    t = tables()
    for batch in batches:
        found = [t.across(s) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([a.astype(np.uint8).tobytes() for a, _ in found], pa.binary()),
             pa.array([p.astype("<i8").tobytes() for _, p in found], pa.binary())],
            names=[*batch.schema.names, "leads", "paid"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation from the last to the first: the vector behind each, and the whole cost."""
    t = tables()
    for batch in batches:
        starts, rights, first, costs = [], [], [], []
        for runs in batch.column("runs").to_pylist():
            at, total, own = 0, 0, []
            for run in reversed(runs):
                own.append(at)
                total += int(np.frombuffer(run["paid"], "<i8")[at])
                at = run["leads"][at]
            total += t.vectors[at][0]
            starts += [r["start"] for r in runs]
            rights += own[::-1]
            first += [True] + [False] * (len(runs) - 1)
            costs += [total] * len(runs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int64()), pa.array(rights, pa.int32()), pa.array(first, pa.bool_()), pa.array(costs, pa.int64())],
            names=["start", "right", "first", "cost"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's edits and the state behind them, from every state that can be before it."""
    t = tables()
    for batch in batches:
        rows = batch.to_pylist()
        found = [t.walk(r["symbols"], r["right"], [0] if r["first"] else [0, 1, 2, 3]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv", "start", "symbols", "cost")],
             pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())),
             pa.array([[q for _, q in f] for f in found], pa.list_(pa.int32()))],
            names=["conv", "start", "symbols", "cost", "audits", "ends"])


class _Conversation:
    """Counts and digest of one conversation, row by row."""

    def __init__(self, conv: object) -> None:
        self.conv, self.state, self.cost = conv, 0, 0
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.role = None
        self.turns = 0

    def write(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        self.write(GIVEN[self.at], "")
        self.at = NEXT[self.at]

    def run(self, row: dict) -> None:
        choice = min(self.state, len(row["audits"]) - 1)
        self.symbols, self.letters = iter(row["symbols"]), iter(row["audits"][choice])
        self.at, self.state, self.cost = self.state, row["ends"][choice], row["cost"]
        self.audit.append(row["audits"][choice])

    def turn(self, row: dict) -> None:
        symbol = next(self.symbols)
        if symbol == "-":
            return
        role = row["role"]
        self.illegal += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        self.blank += symbol == "b"
        self.duplicate += symbol == "d"
        self.truncated += symbol.isupper()
        if row["turn"] is not None:
            self.turns += row["turn"] != self.high
            self.low, self.high = row["turn"] if self.low is None else self.low, row["turn"]
        letter = next(self.letters)
        while letter == "I":
            self.insert()
            letter = next(self.letters)
        if letter == "K":
            self.write(role, row["text"])
            self.at = KEPT[symbol.lower()][self.at]
        elif letter == "R":
            self.write(GIVEN[self.at], row["text"])
            self.at = NEXT[self.at]

    def result(self) -> tuple:
        tail = TAIL[self.state]
        self.at = self.state
        for _ in tail:
            self.insert()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join([*self.audit, tail]), self.digest.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its runs and turns in order; only the conversation at hand is open."""
    now: _Conversation | None = None
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv").type
        done = []
        for row in batch.select(["conv", "turn", "role", "text", "symbols", "audits", "ends", "cost"]).to_pylist():
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(row["conv"])
            if row["symbols"] is None:
                now.turn(row)
            else:
                now.run(row)
        if done:
            yield _result_batch(done, kind)
    if now is not None:
        yield _result_batch([now.result()], kind)


def _result_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", *[c.split()[0] for c in RESULT.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, text; other columns are left out): its faults and its repair.

    gaps, blank, duplicate, truncated, illegal count faults; cost and audit are the cheapest edits (Keep, Rerole, Delete,
    Insert) that make the roles ``(s?(ua)+)?``, the ASCII-least audit among equals; repaired_sha256 is the digest of the
    repaired ``role:text`` lines. Rows where ``present`` is not true only name their conversation.

    Nulls: a null role or text is one space, so a null text is blank and a null role fits nowhere; null turns come first and
    count in no gap; null conv_ids are one conversation. Ties of turn go by role, the text's first 64 characters and
    its hash. Repeated rows are duplicates of the first. Role and text are compared by a 128-bit digest. An empty
    table gives no rows. gaps are held at 2^63 - 1. Texts of any length pass whole, one row at a time.

    Rows are sorted over all partitions, so that a conversation of any length is spread; each part of it is a run.
    (1) Each run's transition of all cost vectors is looked up block by block. (2) The vectors behind the runs of a
    conversation follow from these transitions, a row for each part of the table it touches. (3) Each run is traced
    from the states that can be before it. (4) The rows of a conversation pass in order through its digest, which
    is the one thing that cannot be cut; only a row at a time is held, and the audit.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(
        F.col("conv_id").alias("conv"), "turn", here.alias("here"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    first = F.substring("role", 1, 1)
    role = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    symbol = F.when(~F.col("here"), "-").when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    same = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("symbol", symbol).withColumn("same", same)
    rows = in_order(rows, turn_order("conv", "turn", "role", "text"), ["conv", "turn", "role", "text", "symbol", "same"], "turns")
    earliest = rows.where(~F.col("symbol").isin("-", "b")).groupBy("conv", "same").agg(F.min("place").alias("place"))
    marked = rows.select("conv", "part", "place", "symbol").join(earliest.select("place", F.lit(True).alias("new")), "place", "left").withColumn(
        "symbol", F.when(F.col("new") | F.col("symbol").isin("-", "b"), F.col("symbol")).otherwise("d"))
    runs = marked.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("row")).select(
        "conv", F.col("row")[0]["place"].alias("start"), F.array_join(F.col("row.symbol"), "").alias("symbols"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    runs = materialised(runs.mapInArrow(_summaries, f"conv {kind}, start long, symbols string, leads binary, paid binary"), "runs")
    borders = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "leads", "paid"))).alias("runs")) \
        .select("runs").mapInArrow(_borders, "start long, right int, first boolean, cost long")
    traced = runs.select("conv", "start", "symbols").join(borders, "start").mapInArrow(
        _traced, f"conv {kind}, start long, symbols string, cost long, audits array<string>, ends array<int>")
    both = traced.withColumnRenamed("start", "place").withColumn("kind", F.lit(0)).unionByName(
        rows.select("conv", "turn", "role", "text", "place").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "place", "kind").mapInArrow(_results, f"conv {kind}, {RESULT}") \
        .withColumnRenamed("conv", "conv_id")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` after the planted damage, nulls as one space; dropped rows stay with ``present`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fault") != 0).alias("present"), again.alias("_copy")).drop("_copy")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, F.col("present"))


def _sql() -> str:
    """The same by recursion over the rows of a conversation: of each state the least (cost, edits) and its text."""
    none = "{c: 1000000, a: '', t: ''}"

    def edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
        return f"{{c: {state}.c + {cost}, a: {state}.a || '{letter}', t: {state}.t" + (f" || chr(10) || {line}}}" if line else "}")

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def keep(state: str, first: str) -> str:
        return f"CASE WHEN sym = '{first}' THEN {edit(state, 'K', 'cut', 'role || chr(58) || text')} ELSE {none} END"

    def rerole(state: str, role: str) -> str:
        return f"CASE WHEN sym <> 'd' THEN {edit(state, 'R', '2 + cut', f"'{role}:' || text")} ELSE {none} END"

    drop = [edit(f"s{q}", "D", "3") for q in range(4)]
    return f"""
WITH RECURSIVE {CRC_TABLE},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fault FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw WHERE fault <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM raw WHERE fault = 3),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
marked AS (
  SELECT *, CASE WHEN bare = '' OR seen > 1 THEN 'd' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS sym,
    CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM told),
counted AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (bare = '') AS blank,
    count(*) FILTER (bare <> '' AND seen > 1) AS duplicate, count(*) FILTER (bare <> '' AND seen = 1 AND cut = 1) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
rowed AS (
  SELECT conv_id, 0 AS i, {{c: 0, a: '', t: ''}} AS s0, {none} AS s1, {{c: 2, a: 'I', t: chr(10) || 'user:'}} AS s2,
    {{c: 4, a: 'II', t: chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n0, n1, c2, {least("n3", edit("c2", "I", "2", "'assistant:'"))} FROM (
    SELECT *, {least("n2", *[edit(n, "I", "2", "'user:'") for n in ("n0", "n1", "n3")])} AS c2 FROM (
      SELECT w.conv_id, m.i, {drop[0]} AS n0, {least(drop[1], keep("s0", "s"))} AS n1,
        {least(drop[2], *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))])} AS n2,
        {least(drop[3], keep("s2", "a"), rerole("s2", "assistant"))} AS n3
      FROM rowed w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
done AS (SELECT conv_id, {least("s0", "s3")} AS best FROM rowed QUALIFY i = max(i) OVER (PARTITION BY conv_id))
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM done d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""


OP11_SQL = _sql()
