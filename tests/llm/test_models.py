"""Language ID, language-model scores, top-k search, byte-level BPE, sharding and mixing."""

import os
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

import cases  # noqa: E402
from saleswright.llm import bpe, langid, maxent, mixing, sharding, topk  # noqa: E402
from saleswright.llm.common import remainder, running_totals  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.DOCUMENTS).repartition(4)


# --- language ID --------------------------------------------------------------------------------

def test_languages(docs):
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    assert model.languages == ["de", "en"] and len(model.centroids) > 2
    found = langid.predict(docs.withColumn("score", F.lit("x")), model).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in found if r["text"] is None or not any(c.isalpha() for c in r["text"]))
    held = [r for r in found if r["doc_id"] and r["doc_id"] >= 100 and not cases.in_training(r["doc_id"], 4)]
    assert held and all(r["lang_pred"] == r["lang"] and not r["rejected"] and 0 < r["score"] <= 1 for r in held)
    again = langid.predict(docs, langid.fit(docs.where(remainder("doc_id", 4) != 2))).collect()
    assert sorted(map(str, ((r["doc_id"], r["lang_pred"], r["score"]) for r in again))) == sorted(map(str, ((r["doc_id"], r["lang_pred"], r["score"]) for r in found)))


def test_another_script_is_rejected(spark, docs):
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "日本語の文章はここにあります" * 3)], "doc_id long, text string")
    assert langid.predict(odd, model).first()["rejected"]


def test_no_labels_and_no_rows(docs):
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_ngrams_of_pieces_are_those_of_the_whole():
    text = cases.prose(3, 400)
    assert (langid.ngram_counts(text, step=100) == langid.ngram_counts(text)).all()


# --- language model -----------------------------------------------------------------------------

def test_base_scores_and_gain(docs):
    rows = cases.documents()
    wanted, total = cases.base_scores(rows)
    found = maxent.score_texts(docs, remainder("doc_id", 7) != 2).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found)
    assert mine == sorted((str(r[0]), n, k, round(float(b), 6)) for r, (n, k, b) in zip(rows, wanted))
    assert {r["train_tokens"] for r in found} == {total}
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_shares_and_sums_of_a_batch_need_little_beyond_their_results():
    draw = np.random.default_rng(3)
    weights = np.clip(draw.standard_normal((maxent.CLASS_ROWS, maxent.CLASSES)) * 4, -maxent.LARGEST, maxent.LARGEST).astype(np.float32)
    rows = [draw.integers(0, maxent.CLASS_ROWS, 1 << 16).astype(np.uint16) for _ in range(4)]
    start = np.log(draw.random(maxent.CLASSES) + 1e-9).astype(np.float32)
    tracemalloc.start()
    p = maxent._softmax(start, weights, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * p.nbytes  # the rest is in parts that stay in the cache
    z = start.astype(float) + sum(weights[r].astype(float) for r in rows)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(p, z / z.sum(axis=1, keepdims=True), rtol=1e-4, atol=1e-7)
    for r in (rows[0], np.sort(rows[0]), np.full(1 << 16, 5, np.uint16)):
        total, wanted = np.zeros((maxent.CLASS_ROWS, maxent.CLASSES), np.float32), np.zeros((maxent.CLASS_ROWS, maxent.CLASSES))
        maxent._add_rows(total, r, p)
        np.add.at(wanted, r, p.astype(float))
        assert np.allclose(total, wanted, rtol=1e-3)


def test_probabilities_add_up_to_one():
    draw = np.random.default_rng(2)
    model = maxent.Model(*(np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32) for x in (draw.random(maxent.CLASSES), draw.random((maxent.CLASSES, maxent.MEMBERS)))),
                         draw.standard_normal((maxent.CLASS_ROWS, maxent.CLASSES)).astype(np.float32), draw.standard_normal((maxent.MEMBER_ROWS, maxent.MEMBERS)).astype(np.float32))
    total = 0.0
    for cell in range(maxent.CELLS):  # the last token varies over the cells, the words before stay
        chunk = maxent.Chunk([3], np.array([1, 2, 0], "<u4").tobytes(), np.array([1024 + cell, 2048 + 3, 4096 + 9], "<u8").tobytes())
        rows, members, own = chunk.features(np.array([2]))
        p = maxent._softmax(model.class_prior, model.class_weights, rows)[0, cell // maxent.MEMBERS]
        total += p * maxent._softmax(model.member_prior[own // maxent.MEMBERS], model.member_weights, members)[0, cell % maxent.MEMBERS]
    assert total == pytest.approx(1, abs=1e-4)


def test_scores_of_nothing(docs):
    assert maxent.score_texts(docs.limit(0), F.lit(True)).count() == 0
    none = maxent.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == len(cases.documents()) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in none)


# --- top-k --------------------------------------------------------------------------------------

def plain_top(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("segments,block", [(2, 4096), (3, 50), (1, 4096)])
def test_top_inner_products(spark, segments, block):
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-20, 21, 7).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)] + [(2000 + i, [1, 2]) for i in range(3)] + [(3000, []), (3001, []), (4000, [-5] * 7)]
    queries = [r for r in rows if r[0] % 20 == 0]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, v array<long>")
    found = topk.top_inner_products(frame(rows), frame(queries), 5, segments, block)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, queries, 5)


def test_repeated_rows_are_asked_and_answered_each(spark):
    draw = np.random.default_rng(14)
    rows = [(i, draw.integers(-9, 10, 6).tolist()) for i in range(120)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (0, rows[5][1]), (20, rows[7][1]), (33, rows[33][1]), (33, rows[33][1])] + [(40, rows[i][1]) for i in range(30)]
    queries = [r for r in rows if r[0] % 20 == 0]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, v array<long>").repartition(3)
    for segments, block in ((2, 4096), (3, 40)):
        found = topk.top_inner_products(frame(rows), frame(queries), 5, segments, block)
        assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, queries, 5)


def test_large_components_and_bad_vectors(spark):
    big = 1 << 30
    rows = [(i, [big - i, 3, -(i**2)]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk.top_inner_products(frame, frame.where("vec_id % 5 = 0"), 3).collect()) == plain_top(rows, rows[::5], 3)
    odd = spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [None]), (4, [float("-inf")]), (5, [0.5])], "i long, x array<float>")
    assert [r["i"] for r in odd.where(topk.usable(F.col("x"))).collect()] == [5]
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_inner_products(empty, empty).count() == 0


# --- byte-level BPE -----------------------------------------------------------------------------

P = pytest.importorskip("public_tokenizers")


def test_bpe_as_the_library_does(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = bpe.encode_decode(docs.withColumn("IDS", F.lit("x")), P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(cases.documents())
    for r in rows:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == plain.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_bpe_of_random_bytes_and_after_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    plain, mine = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.ByteBPE(bpe.read_definition(P.path("byte_bpe_50k.json")))
    draw = np.random.default_rng(6)
    letters = list("abcehnot  ''\n\t.,!-1239éß中\U0001f600st") + ["<|endoftext|>", "the", "ing"]
    texts = ["".join(draw.choice(letters, draw.integers(0, 80))) for _ in range(400)] + ["ab" * 3000, " " * 999]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_nothing(docs):
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# --- sharding -----------------------------------------------------------------------------------

@pytest.mark.parametrize("bucket", [4 << 20, 5000])
def test_shards(docs, tmp_path, bucket):
    given = docs.withColumn("Shard", F.lit("x")).withColumn("bucket", F.lit(1))
    found = sharding.external_shuffle(given, 5, bucket_bytes=bucket).collect()
    assert len(found) == len(cases.documents())
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(str((r["doc_id"], r["text"])) for r in found) == sorted(str(r[:2]) for r in cases.documents())
    again = sharding.external_shuffle(given, 5, bucket_bytes=bucket).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["slot"], r["shard"])) if r["doc_id"] and r["doc_id"] >= 100]
    assert order != sorted(order)


def test_written_shards(spark, docs, tmp_path):
    path = sharding.write_shards(sharding.external_shuffle(docs, 3), str(tmp_path / "shards"), rows_per_file=20)
    assert spark.read.parquet(path).count() == len(cases.documents())
    assert sharding.external_shuffle(docs.limit(0)).count() == 0


def test_running_totals(spark):
    rows = [(i, (i * 7) % 5) for i in range(100)]
    found = running_totals(spark.createDataFrame(rows, "at long, n long"), "at", "n", "before", width=8).orderBy("at").collect()
    assert [r["before"] for r in found] == np.concatenate(([0], np.cumsum([n for _, n in rows])[:-1])).tolist()


# --- mixing -------------------------------------------------------------------------------------

def plain_targets(sizes):
    """Targets of sources in order, by raising the level until nothing is left to share out."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        for s in full or free:
            target[s] = 2 * sizes[s] if full else weight[s] * level
        left -= sum(2 * sizes[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    return target


def test_mix(docs):
    mixed = mixing.pivotal_mix(docs.withColumn("copies", F.lit("x")).withColumn("tag", F.lit(0)), block=8)
    rows = mixed.collect()
    assert len(rows) == len(cases.documents()) and {"lang", "tag", "text"} < set(mixed.columns)
    sizes, largest = {}, {}
    for _, text, _, source, _ in cases.documents():
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    target = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - target[s]) <= largest[s] + 1e-6
    assert all(0 <= r["copies"] <= 2 for r in rows)
    again = mixing.pivotal_mix(docs.repartition(3), block=8).collect()
    assert sorted(str((r["doc_id"], r["text"], r["copies"])) for r in again) == sorted(str((r["doc_id"], r["text"], r["copies"])) for r in rows)
    assert mixing.repeated(mixed).count() == sum(r["copies"] for r in rows)


def test_expected_copies(spark):
    """Over many seeds each row's mean of copies is its share, whatever its size."""
    frame = spark.createDataFrame([(i, "s" if i < 12 else "t", 5 + 10 * (i % 12)) for i in range(24)], "doc_id long, source string, n long")
    total = np.zeros(24)
    for seed in range(12):
        for r in mixing.pivotal_mix(frame.withColumnRenamed("n", "w"), (1.0, 1.0), 0.5, 2.0, seed * 31, 6, F.col("w")).collect():
            total[r["doc_id"]] += r["copies"]
    assert 0.3 < total.sum() / (12 * 24) < 0.7 and total.max() < 12 and (total > 0).sum() > 18


def test_mix_of_nothing_and_of_wordless_rows(spark, docs):
    assert mixing.pivotal_mix(docs.limit(0)).count() == 0
    none = mixing.pivotal_mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(none) == len(cases.documents()) and all(r["target"] == 0 and r["size"] == 0 for r in none)
