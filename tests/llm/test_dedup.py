"""Embedding, SimHash, line and byte-string dedup against plain versions."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

import cases  # noqa: E402
from saleswright.llm import common, forest, lines, simhash, suffixes  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.DOCUMENTS).repartition(4)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    found = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings ---------------------------------------------------------------------------------

def vectors(n=260, d=16):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(d).astype(float).tolist()) for i in range(n)]
    for i in range(40):  # near copies, and exact ones
        rows.append((1000 + i, (np.array(rows[i % 7][1]) + 0.05 * draw.standard_normal(d)).tolist()))
        rows.append((2000 + i, rows[3][1]))
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [1.0] * 3, [2.0] * 3]
    return rows + [(3000 + i, v) for i, v in enumerate(odd)] + [(None, rows[3][1])]


def plain_links(rows, cosine):
    usable = [k is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for k, v in rows]

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        return usable[i] and usable[j] and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine

    root = cases.groups(len(rows), linked)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, 10**9), rows[i][0] if rows[i][0] is not None else 10**9)
    return {r[0]: (sum(linked(i, j) for j in range(len(rows)) if j != i), None if r[0] is None else low[root[i]]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("leaf", [1024, 24])
def test_forest_links_what_brute_force_links(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF_ROWS", leaf)  # with small leaves, trees split and heaps are cut into blocks
    rows = vectors()
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    wanted = plain_links(rows, 0.95)
    assert found.keys() == wanted.keys()
    links = sum(n for n, _ in wanted.values())
    assert sum(n for n, _, _ in found.values()) >= 0.9 * links > 0
    assert all(found[k][0] <= wanted[k][0] for k in wanted)
    if leaf == 1024:
        assert {k: v[:2] for k, v in found.items()} == wanted
    assert all(v[2] == (k == v[1] and k is not None) for k, v in found.items())


@pytest.mark.parametrize("heap,others", [(16_000, 0), (10_000, 20_000)])
def test_trees_do_not_cut_a_large_heap(heap, others):
    draw = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = unit(np.concatenate([unit(draw.standard_normal((1, 64))) + 0.018 * draw.standard_normal((heap, 64)), draw.standard_normal((others, 64))]))
    order = draw.permutation(len(rows))
    trees = [forest.grow(rows[order], 1024, 17 + i) for i in range(forest.TREES)]
    a, b = draw.integers(0, heap, (2, 4000))
    met = np.zeros(4000, bool)
    for t in trees:
        leaves = np.zeros((heap, t.leaves), bool)
        leaves[t.leaves_of(rows[:heap])] = True
        met |= (leaves[a] & leaves[b]).any(axis=1)
    assert ((rows[a] * rows[b]).sum(axis=1) >= 0.95).mean() > 0.99
    assert met.mean() >= 0.99
    assert others == 0 or min(t.leaves for t in trees) > 8  # the rest is still split


def test_every_length_has_its_links(spark):
    rows = [(2 * n + k, [1.0 + k / 100] + [1.0] * n) for n in range(1100) for k in (0, 1) if n]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == len(rows) and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 2 * 2 for r in found)


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e160, 1e160]), (2, [1e160, 1.01e160]), (3, [1e-170, 1e-170]), (4, [5e-324, 0.0]), (5, [0.0, 3e-320]), (6, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [1.7e308, -1.7e308])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5), 7: (0, 7), 8: (0, 8)}


def test_forest_of_nothing(spark):
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, kept string")).count() == 0
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in forest.near_duplicates(only).collect()] == [(1, 0, 1, True)]


# --- fingerprints -------------------------------------------------------------------------------

def test_simhash_groups(spark, docs):
    rows = cases.documents()
    prints = [cases.fingerprint(r[1]) for r in rows]
    root = cases.groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    low = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            low[r] = min(low.get(r, 10**9), rows[i][0])
    wanted = sorted((str(r[0]), f"{p:016x}", str(low.get(g))) for r, p, g in zip(rows, prints, root))
    found = simhash.simhash_groups(docs.withColumn("fingerprint", F.lit("x")).withColumn("component", F.lit(1)))
    assert sorted((str(r["doc_id"]), f"{r['fingerprint'] % 2**64:016x}", str(r["component"])) for r in found.collect()) == wanted


@pytest.mark.parametrize("distance,block", [(4, 4096), (4, 8), (8, 16), (1, 4), (0, 4096)])
def test_near_links_reach_all_pairs(spark, distance, block):
    draw = np.random.default_rng(distance)
    prints = [int(x) for x in draw.integers(-(2**63), 2**63, 60)]
    for p in list(prints[:6]):
        for n in range(1, 25):
            x = p % 2**64
            for bit in draw.choice(64, n % 11, replace=False):
                x ^= 1 << int(bit)
            prints.append(x - 2**64 * (x >> 63))
    prints = sorted(set(prints))
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "id long"), distance, block).collect()
    near = lambda i, j: ((prints[i] ^ prints[j]) % 2**64).bit_count() <= distance
    at = {p: i for i, p in enumerate(prints)}
    pairs = {(at[r["a"]], at[r["b"]]) for r in links}
    assert cases.groups(len(prints), near) == cases.groups(len(prints), lambda i, j: (i, j) in pairs or (j, i) in pairs)


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(17) == 1 and 18 not in ids  # a repeated row and a copy
    assert 1 in ids and 2 not in ids and 3 not in ids
    assert sum(i in ids for i in (7, 8, 9, 16)) == 1  # wordless texts are alike
    assert all(i in ids for i in range(100, 140))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def words_of(*parts):
    return " ".join(f"w{p}" for part in parts for p in part)


@pytest.mark.parametrize("room", [8 << 20, 700])
def test_copies_go_whatever_leads_their_fingerprints(spark, monkeypatch, room):
    # All fingerprints are as near as chance could bring them; 1 leads and is like none of the others.
    monkeypatch.setattr(simhash, "fingerprint_of_hashes", lambda hashes: 7)
    monkeypatch.setattr(simhash.verified_links, "__defaults__", (room,))
    a, b, c = range(0, 40), range(100, 140), range(200, 260)
    rows = [(1, words_of(a)), (2, words_of(b)), (3, words_of(b)), (4, words_of(c)), (5, words_of(c, [1])), (6, words_of([2], c, [1])),
            (7, words_of(range(300, 340))), (8, words_of(a, [3])), (9, words_of(a, [4, 5]))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 4, 7]


@pytest.mark.parametrize("block", [4096, 16])
def test_wide_links_find_pairs_at_the_least_similarity(spark, block):
    draw = np.random.default_rng(12)
    rows = []
    for i in range(300):  # two sets of 100 with 89 in common: Jaccard 0.80
        both, one, two = (draw.integers(0, 2**63, n).astype("<u8") for n in (89, 11, 11))
        rows += [(2 * i + k, *simhash.two_fingerprints(np.concatenate([both, x]))) for k, x in enumerate((one, two))]
    links = simhash.wide_links(spark.createDataFrame(rows, "id long, f long, g long"), block=block)
    found = {tuple(sorted(r)) for r in links.collect()}
    assert sum((2 * i, 2 * i + 1) in found for i in range(300)) >= 0.95 * 300
    assert sum(a // 2 != b // 2 for a, b in found) < 10


def test_one_near_fingerprint_links_whatever_the_other(spark):
    # Jaccard 0.8, and 8 and 6 bits apart in one fingerprint but 24 and 25 in the other.
    texts = ["w629764 w942384 w575523 w347936 w797306 w298691 w818151 w508504 w357521", "w5632 w723300 w234239 w684189 w458818 w115997 w247461 w359454 w874366"]
    rows = [(2 * i + k, t if k else t.rsplit(" ", 1)[0]) for i, t in enumerate(texts) for k in (0, 1)]
    prints = [(i, *simhash.two_fingerprints(np.frombuffer(simhash.shingle_set(t, 5, 42), "<u8"))) for i, t in rows]
    links = simhash.wide_links(spark.createDataFrame(prints, "id long, f long, g long")).collect()
    assert {tuple(sorted(r)) for r in links} == {(0, 1), (2, 3)}
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 2]


def test_verified_links_connect_what_all_pairs_do():
    draw = np.random.default_rng(6)
    base = [set(draw.integers(0, 2**60, 30).tolist()) for _ in range(8)]
    sets = [set(list(base[i % 8])[: 30 - i % 5]) | set(draw.integers(0, 2**60, i % 7).tolist()) for i in range(80)] + [set(), set()]
    held = [np.sort(np.array(list(x), "<u8")).tobytes() for x in sets]
    like = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    pairs = set(simhash.verified(held, 0.8))
    assert all(like(a, b) for a, b in pairs)
    assert cases.groups(len(sets), like) == cases.groups(len(sets), lambda i, j: (i, j) in pairs or (j, i) in pairs)


# --- lines --------------------------------------------------------------------------------------

def plain_lines(rows, run, words):
    """Maximal runs of lines that follow each other at an earlier place too, from each line on."""
    at, out = {}, []
    texts = list(dict.fromkeys(r[:2] for r in ordered(rows)))
    split = [[] if t is None else t.split("\n") for _, t in texts]
    gone = {t: set() for t in texts}
    for d, text in enumerate(split):
        for p, line in enumerate(text):
            for e, q in at.get(line, ()):
                n = 0
                while p + n < len(text) and q + n < len(split[e]) and text[p + n] == split[e][q + n]:
                    n += 1
                if n >= run or sum(len(x.encode().split()) for x in text[p:p + n]) >= words:
                    gone[texts[d]].update(range(p, p + n))
            at.setdefault(line, []).append((d, p))
    for r in rows:
        cut = gone[r[:2]]
        out.append((r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in cut), len(cut)))
    return out


def line_cases():
    one, a, b = cases.prose(31, 55), cases.prose(32, 28), cases.prose(33, 22)
    short = cases.prose(34, 49)
    return cases.documents() + [
        (300, "\n".join(["top", one, a, b, "end"]), "en", "a", 1), (301, one, "en", "a", 1), (302, one + "\n" + one, "en", "a", 1),
        (303, "\n".join([cases.prose(35, 9), a, b]), "en", "a", 1), (304, a, "en", "a", 1), (305, b + "\n" + a, "en", "a", 1),
        (306, short, "en", "a", 1), (307, short + "\nnew", "en", "a", 1), (308, short + "\nnew", "en", "a", 1), (None, one + "\u00a0x\n" + one, "en", "a", 1)]


@pytest.mark.parametrize("run,words", [(1, 50), (2, 50), (3, 50), (5, 50), (3, 12), (4, 10 ** 9)])
def test_lines(spark, run, words):
    docs = spark.createDataFrame(line_cases(), cases.DOCUMENTS)
    wanted = sorted(map(str, plain_lines(line_cases(), run, words)))
    found = lines.dedup_lines(docs.withColumn("n_removed", F.lit("x")).withColumn("_RUNS", F.lit(1)), run, words)
    assert sorted(str((r["doc_id"], r["text"], r["n_removed"])) for r in found.collect()) == wanted
    assert "lang" in found.columns and found.columns.count("n_removed") == 1


def test_a_repeated_line_of_fifty_words_goes_and_a_shorter_one_stays(spark):
    docs = spark.createDataFrame(line_cases(), cases.DOCUMENTS)
    cut = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect() if r["doc_id"] and r["doc_id"] >= 300}
    assert cut == {300: 0, 301: 1, 302: 2, 303: 2, 304: 0, 305: 0, 306: 0, 307: 0, 308: 2}


def test_winnowing_keeps_one_place_of_each_window():
    draw = np.random.default_rng(1)
    h = draw.integers(0, 9, 300).astype(np.uint64)
    chosen = set(lines.winnow(h, 4).tolist())
    assert all(chosen & set(range(i, i + 4)) for i in range(297))
    assert (np.diff(lines.winnow(h, 4)) >= 0).all() and not len(lines.winnow(h[:3], 4))


def test_lines_of_nothing(docs):
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# --- byte strings -------------------------------------------------------------------------------

@pytest.mark.parametrize("length,chunk", [(100, 4 << 20), (40, 4 << 20), (100, 3000)])
def test_repeated_strings(docs, monkeypatch, length, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "MERGE", 300)
    rows, seen = [], set()
    for r in ordered(cases.documents()):
        if r[:2] not in seen:
            rows.append(r)
        seen.add(r[:2])
    spans = cases.repeated_bytes([r[1] for r in rows], length)
    wanted = {(r[0], (r[1] or "").encode()): s for r, s in zip(rows, spans)}
    found = suffixes.without_spans(suffixes.repeated_strings(docs.withColumn("spans", F.lit(0)).withColumn("chunk", F.lit("x")), length)).collect()
    assert len(found) == len(cases.documents())
    for r in found:
        assert [(s["start"], s["end"]) for s in r["spans"]] == wanted[r["key"], bytes(r["text"])], r["key"]
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert bytes(r["kept"]) == bytes(c for i, c in enumerate(r["text"]) if i not in gone)
    assert sum(map(len, spans)) > 5


def test_repeated_strings_of_nothing(docs):
    assert suffixes.repeated_strings(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_strings(docs, 32)


def test_merge_never_reads_shared_prefixes_again():
    draw = np.random.default_rng(8)
    runs = []
    for k in range(7):
        run = sorted(bytes(draw.integers(97, 99, draw.integers(1, 12)).astype(np.uint8)) for _ in range(draw.integers(0, 60)))
        lcp = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(run, run[1:])]
        runs.append((run, lcp[: len(run)]))
    got = list(suffixes.merge_runs(runs))
    merged = [runs[r][0][i] for r, i, _ in got]
    assert merged == sorted(x for r, _ in runs for x in r)
    assert [n for *_, n in got][1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:])]
