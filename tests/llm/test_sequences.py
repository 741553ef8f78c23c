"""Conversations and vectors with every odd case, against SQL by recursion, direct counts and plain rankings."""

import itertools
from collections import Counter

import duckdb
import numpy as np
import oracle
import pytest

from saleswright.llm import ordered, prefixtrie, repair, vptree

TURNS = "conv_id long, turn long, role string, text string, part int, place string"


def conversations() -> list[tuple]:
    draw = np.random.default_rng(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "why?", "cut", " ", "", None, "naïve \U0001f600.", "a.b. \n"]
    rows = []
    for c in range(60):
        rows += [(c, t, roles[draw.choice(6, p=[.35, .35, .1, .1, .05, .05])], texts[draw.choice(9)] if draw.random() < .5 else f"turn {draw.integers(30)}.") for t in range(draw.integers(1, 30))]
    rows += [(100, t, "user" if t % 2 else "assistant", "the same.") for t in range(40)]
    rows += [(101, None, "user", "no turn."), (101, None, "assistant", "none."), (101, 5, "user", "x."), (101, 5, "user", "x."), (101, 5, "assistant", "y")]
    rows += [(None, 1, "user", "nobody."), (None, 2, "assistant", "nobody."), (-3, 0, "user", "below."), (-3, -4, "assistant", "zero.")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}.") for c in range(200, 260) for t in range(14)]
    rows += [(300, 0, "user", "long " * 100_000 + "."), (301, -(1 << 63), "user", "least."), (301, (1 << 63) - 1, "assistant", "most.")]
    rows += [(c, t, None if t == 3 else "user", f"{c % 3} {t}") for c in range(400, 420) for t in range(c % 9)]
    return [(*r, 1, "x") for r in rows]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(conversations(), TURNS).repartition(5).cache()


def twin(turns, sql):
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    return con, sql


def repaired(turns):
    rows = repair.damaged(turns)
    return repair.repair(rows, rows["present"])


@pytest.mark.parametrize("part_rows", [97, 65_536])
def test_repairs_are_those_of_the_recursion(turns, monkeypatch, part_rows):
    monkeypatch.setattr(ordered, "PART_ROWS", part_rows)
    some = turns.where("conv_id is null or conv_id <> 301")  # the gap of 301 is beyond 64 bits in SQL
    assert oracle.difference(repaired(some), *twin(some, repair.OP11_SQL)) is None


def test_gaps_are_held_in_64_bits(turns):
    found = repaired(turns.where("conv_id = 301")).collect()
    assert len(found) == 1 and 0 <= found[0]["gaps"] <= (1 << 63) - 1


def plain_repair(symbols: str) -> tuple[int, str]:
    """Least (cost, edits) by trying every edit of every row, state by state."""
    best = {0: (0, "")}

    def inserted(states):
        for _ in range(4):
            for q, (cost, edits) in list(states.items()):
                new = (cost + 2, edits + "I")
                if new < states.get(repair.NEXT[q], (1 << 40, "")):
                    states[repair.NEXT[q]] = new
        return states

    best = inserted(best)
    for s in symbols:
        after: dict = {}
        for q, (cost, edits) in best.items():
            options = [(0, "", q)] if s == "-" else [(3, "D", q)]
            if s not in "-db":
                cut = s.isupper()
                options.append((2 + cut, "R", repair.NEXT[q]))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(s.lower(), {}).get(q)
                if to is not None:
                    options.append((cut, "K", to))
            for more, letter, to in options:
                new = (cost + more, edits + letter)
                if new < after.get(to, (1 << 40, "")):
                    after[to] = new
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def test_blocks_give_the_least_edits():
    t = repair.tables()
    draw = np.random.default_rng(3)
    strings = ["".join(x) for n in range(4) for x in itertools.product("dsuUaAoO", repeat=n)]
    strings += ["".join(draw.choice(list("-bdsSuUaAoO"), draw.integers(1, 40))) for _ in range(500)]
    for s in strings:
        leads, paid = t.across(s)
        (letters, state), *_ = t.walk(s, 0, [0])
        assert (int(paid[0]) + t.vectors[leads[0]][0], letters + repair.TAIL[state]) == plain_repair(s), s


def test_vectors_are_few_and_small():
    t = repair.tables()
    assert len(t.vectors) < 40 and max(max(v) for v in t.vectors) <= 5


def test_nothing_to_repair(spark):
    assert repaired(spark.createDataFrame([], TURNS)).count() == 0
    gone = repair.repair(spark.createDataFrame([(1, 1, "user", "a.", 0, "")], TURNS), repair.F.lit(False)).collect()
    assert [tuple(r)[:8] for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("floors,band,group_turns,most", [((0, 2), 4, 65_536, 99), ((0, 2), 4, 0, 9), ((0, 8, 64, 512), 4096, 65_536, 99), ((0, 8, 64, 512), 4096, 100, 12)])
def test_trie_is_that_of_all_prefixes(turns, monkeypatch, floors, band, group_turns, most):
    monkeypatch.setattr(prefixtrie, "FLOORS", floors)
    monkeypatch.setattr(prefixtrie, "BAND", band)
    monkeypatch.setattr(ordered, "PART_ROWS", 200)
    some = turns.where(f"coalesce(turn, 0) < {most}")
    found = prefixtrie.rebuilt_trie(some, group_turns)
    assert oracle.difference(found, *twin(some, prefixtrie.OP13_SQL)) is None


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefixtrie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = prefixtrie.rebuilt_trie(spark.createDataFrame([(8, 0, "user", "x", 0, "")], TURNS)).collect()
    assert [tuple(r)[:7] for r in alone] == [(8, 0, None, 1, 0, 1, 0)]  # five turns are asked of an absent conversation


def test_one_conversation_over_many_parts(spark, monkeypatch):
    """A third of all rows belong to one conversation; no part holds much more than its share."""
    monkeypatch.setattr(ordered, "PART_ROWS", 150)
    rows = [(0, t, "ua"[t % 2], f"{t}.", 0, "") for t in range(500)] + [(c, t, "ua"[t % 2], f"{t}.", 0, "") for c in range(1, 501) for t in range(2)]
    table = spark.createDataFrame(rows, TURNS)
    placed = ordered.in_order(table.select("conv_id", "turn"), [table["conv_id"].asc(), table["turn"].asc()], ["conv_id"], "t")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 400
    assert oracle.difference(repaired(table), *twin(table, repair.OP11_SQL)) is None
    assert oracle.difference(prefixtrie.rebuilt_trie(table), *twin(table, prefixtrie.OP13_SQL)) is None


VECTORS = "vec_id long, embedding array<float>, label int, ask int, at string"


def vectors() -> list[tuple]:
    draw = np.random.default_rng(12)
    rows = [(i, draw.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, [float(x) for x in draw.integers(-1, 2, 8)]) for i in range(200)]  # many ties
    rows += [(1000 + i, rows[40][1]) for i in range(50)]  # copies
    rows += [(40, rows[41][1]), (40, rows[40][1]), (40, rows[40][1]), (2000, [1e18] * 8), (2020, [-1e-30] * 8)]
    rows += [(3000 + i, [1.0, float(i)]) for i in range(25)] + [(4000, [1.0]), (4020, [2.0])]
    rows += [(None, [1.0] * 8), (5000, None), (5020, [0.0] * 8), (5040, [1.0] * 7 + [float("nan")]), (5060, [1.0] * 7 + [None]), (5080, [float("inf")] * 8), (5100, [])]
    return [(*r, 1, 2, "x") for r in rows]


def plain_nearest(rows: list[tuple], k: int) -> Counter:
    usable = [(i, np.array(v, "f4").astype(float).tolist()) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    out = Counter()
    for i, q in usable:
        if i % 20 == 0:
            ranked = sorted((-score(q, v), j) for j, v in usable if j != i and len(v) == len(q))
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(ranked[:k]))
    return out


@pytest.mark.parametrize("k,shard_bytes,leaf,block", [(20, 8 << 20, 256, 2048), (20, 2000, 4, 7), (3, 5000, 16, 64), (600, 9000, 16, 64)])
def test_factor_one_is_exact(spark, k, shard_bytes, leaf, block):
    rows = vectors()
    table = vptree.usable_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    found = vptree.nearest(table, table.where("vec_id % 20 = 0"), k, 1.0, shard_bytes, leaf, block)
    assert Counter(tuple(r) for r in found.collect()) == plain_nearest(rows, k)


def test_a_larger_factor_compares_less_and_finds_most():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(30, 16))
    points = centres[draw.integers(0, 30, 4000)] + 0.1 * draw.normal(size=(4000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    nodes, order = vptree._grow(points, 32)
    at = np.arange(4000)[order]
    row = {"nodes": nodes.tobytes(), "points": points[order].tobytes(), "d": 16, "at": at.tobytes(), "first": at.tobytes(), "second": np.full(4000, vptree.NONE).tobytes()}
    truth = points[:200] @ points.T
    truth[np.arange(200), np.arange(200)] = -np.inf
    best = -np.sort(-truth, axis=1)[:, 9]
    seen = []
    for factor in (1.0, 1.5):
        tree = vptree.Tree(row)
        i, _, score = tree.search(points[:200], np.arange(200), np.full(200, -np.inf), 10, factor)
        seen.append((tree.compared, np.mean(score >= best[i] - 1e-9)))
    assert seen[0][1] == 1 and seen[1][1] >= 0.9 and seen[1][0] < seen[0][0] < 200 * 4000


def test_nearest_of_nothing(spark):
    empty = vptree.usable_vectors(spark.createDataFrame([], VECTORS))
    assert vptree.nearest(empty, empty).count() == 0
    one = vptree.usable_vectors(spark.createDataFrame([(20, [1.0], 0, 0, "")], VECTORS))
    assert vptree.nearest(one, one).count() == 0 and vptree.nearest(one, empty).count() == 0
