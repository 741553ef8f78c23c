"""Language-model scores of a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import LOWER, bucketed, remainder, table

#: Words fall into classes by a hash of their last two bytes, and in a class into members by one of their last three.
CLASSES, MEMBERS = 32, 16
CELLS = CLASSES * MEMBERS
#: Rows of the weight tables that features are hashed into: for classes, and for members of a class.
CLASS_ROWS = MEMBER_ROWS = 1 << 15
#: Passes over all training texts; in each, a task takes a gradient step for every chunk, and the tasks' weights are averaged.
PASSES = 1
RATE, SMOOTH, LARGEST = 0.4, 20.0, 6.0
#: Tokens of a chunk of texts (a longer text is alone), of a task that sums gradients, of a numpy batch, and of a part of one that stays in the processor's cache.
CHUNK, TASK, BATCH, PART = 1 << 20, 8 << 20, 1 << 15, 1 << 11
BLOCK = 1 << 14
#: What stands for the end of a text; no word holds a newline.
END = b"\n"
TOKEN_SCHEMA = "chunk long, docs array<long>, train array<boolean>, lens array<int>, ids binary, hashes binary, counts binary"


def word_hash(word: bytes) -> int:
    """Stands for the word; its lowest bits are the word's cell, class by class."""
    cell = xxhash.xxh64_intdigest(word[-2:], 1) % CLASSES * MEMBERS + xxhash.xxh64_intdigest(word[-3:], 2) % MEMBERS
    return xxhash.xxh64_intdigest(word) & ~(CELLS - 1) | cell


class _Numbers(dict):
    """Words by the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as token numbers, packed into chunk rows that each carry their own vocabulary."""
    part, seq = TaskContext.get().partitionId(), 0
    words = _Numbers({END: 0})
    docs, train, lens, ids = [], [], [], []
    held = 0

    def packed() -> pa.RecordBatch:
        nonlocal seq, held
        known = list(words)
        numbers = np.concatenate(ids)
        learned = np.concatenate([x for x, t in zip(ids, train) if t] or [numbers[:0]])
        row = pa.RecordBatch.from_arrays([
            pa.array([(part << 24) + seq]), pa.array([docs], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([lens], pa.list_(pa.int32())),
            pa.array([numbers.tobytes()], pa.binary()),
            pa.array([np.fromiter(map(word_hash, known), "<u8", len(known)).tobytes()], pa.binary()),
            pa.array([np.bincount(learned, minlength=len(known)).astype("<u4").tobytes()], pa.binary())],
            names=["chunk", "docs", "train", "lens", "ids", "hashes", "counts"])
        seq, held = seq + 1, 0
        for x in (words, docs, train, lens, ids):
            x.clear()
        words[END] = 0
        return row

    for batch in batches:
        for doc, learn, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "train", "text"))):
            found = (text or b"").translate(LOWER).split()
            if docs and held + len(found) > CHUNK:
                yield packed()
            ids.append(np.fromiter(map(words.__getitem__, (*found, END)), "<u4", len(found) + 1))
            docs.append(doc)
            train.append(learn)
            lens.append(len(found) + 1)
            held += len(found) + 1
    if docs:
        yield packed()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return _mixed(x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))


@dataclass
class Model:
    class_prior: np.ndarray  # log
    member_prior: np.ndarray  # log, by class
    class_weights: np.ndarray
    member_weights: np.ndarray


class Chunk:
    """The token sequences of a chunk with their features."""

    def __init__(self, lens: list[int], ids: bytes, hashes: bytes):
        self.lens = np.array(lens, np.int64)
        self.ids = np.frombuffer(ids, "<u4")
        h = np.frombuffer(hashes, "<u8")
        self.cells = (h & np.uint64(CELLS - 1)).astype(np.int32)
        self.one, self.two = (_salted(h, k) for k in (1, 2))
        self.starts = np.cumsum(self.lens) - self.lens
        self.inside = np.arange(len(self.ids)) - np.repeat(self.starts, self.lens)

    def last_row(self, at: np.ndarray) -> np.ndarray:
        """Row of the class table for the last word."""
        return (np.where(self.inside[at] >= 1, self.one[self.ids[at - 1]], np.uint64(0)) & np.uint64(CLASS_ROWS - 1)).astype(np.uint16)

    def features(self, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Rows of the class table and of the member table that are on at the places, and the cells there.

        Features of the words before: the last; the last two; the last but one alone (a skip); the last two words' cells. Features of
        members, joined with the class: the last word; its cell. Before a text's first word there is none.
        """
        last, skip = at - 1, at - 2
        has1, has2 = self.inside[at] >= 1, self.inside[at] >= 2
        w1, w2 = self.ids[last], self.ids[np.maximum(skip, 0)]
        zero = np.uint64(0)
        a = np.where(has1, self.one[w1], zero)
        b = np.where(has2, self.two[w2], zero)
        c1 = np.where(has1, self.cells[w1] + 1, 0).astype(np.uint64)
        c2 = np.where(has2, self.cells[w2] + 1, 0).astype(np.uint64)
        cell = self.cells[self.ids[at]]
        cls = (cell // MEMBERS).astype(np.uint64)
        rows, members = np.uint64(CLASS_ROWS - 1), np.uint64(MEMBER_ROWS - 1)
        return (
            [(x & rows).astype(np.uint16) for x in (a, b, _mixed(a + (b << np.uint64(1))), _salted(c1 * np.uint64(CELLS + 1) + c2, 3))],
            [(x & members).astype(np.uint16) for x in (_mixed(a ^ ((cls + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))), _salted(c1 * np.uint64(CLASSES) + cls, 4))],
            cell)


def _softmax(start: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Shares of each line. Weights end at ``LARGEST``, so no exponential is beyond 32-bit floats."""
    out = np.empty((len(rows[0]), weights.shape[1]), np.float32)
    ones = np.ones(weights.shape[1], np.float32)
    for low in range(0, len(out), PART):
        at = slice(low, low + PART)
        z = out[at]
        np.add(start if start.ndim == 1 else start[at], weights.take(rows[0][at], axis=0), out=z)
        for r in rows[1:]:
            z += weights.take(r[at], axis=0)
        np.exp(z, out=z)
        z /= (z @ ones)[:, None]
    return out


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, repeated rows included. Over flat arrays, where numpy adds in place without a sort; ordered rows are summed by run, two columns at a time."""
    width = total.shape[1]
    if (rows[1:] >= rows[:-1]).all():
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        total[rows[first]] += np.add.reduceat(values.view(np.complex64), first, axis=0).view(np.float32)
        return
    cells = rows.astype(np.intp)[:, None] * width + np.arange(width)
    np.add.at(total.reshape(-1), cells.reshape(-1), values.reshape(-1))


SIZES = (CLASS_ROWS * CLASSES, CLASS_ROWS, MEMBER_ROWS * MEMBERS, MEMBER_ROWS)


def _steps(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """A task's gradient steps, one for the training texts of each chunk; then its weights, times how often each row was on.

    A step is what was observed less what was expected, over the mass of all the task has seen, so steps grow smaller.
    Both tables come out in blocks, of which those that are zero are left out.
    """
    model = Model(model.class_prior, model.member_prior, model.class_weights.copy(), model.member_weights.copy())
    prior = np.exp(model.class_prior)
    rows_on, members_on = np.zeros(CLASS_ROWS, np.float32), np.zeros(MEMBER_ROWS, np.float32)
    mass = np.zeros((MEMBER_ROWS, MEMBERS), np.float32)
    for batch in batches:
        for learned, lens, ids, hashes in zip(*(batch.column(c).to_pylist() for c in ("train", "lens", "ids", "hashes"))):
            chunk = Chunk(lens, ids, hashes)
            places = np.flatnonzero(np.repeat(np.array(learned, bool), chunk.lens))
            if not len(places):
                continue
            # In order of the last word: its row is then the same for many tokens in a row.
            places = places[np.argsort(chunk.last_row(places), kind="stable")]
            expected, e = np.zeros((CLASS_ROWS, CLASSES)), np.zeros((MEMBER_ROWS, MEMBERS))
            part, member_part = (np.zeros(x.shape, np.float32) for x in (expected, e))
            observed: list[list[np.ndarray]] = [[], []]
            for low in range(0, len(places), BATCH):
                rows, members, cell = chunk.features(places[low:low + BATCH])
                cls = cell // MEMBERS
                p = _softmax(model.class_prior, model.class_weights, rows)
                for r in rows:
                    _add_rows(part, r, p)
                    observed[0].append(r.astype(np.int32) * CLASSES + cls)
                q = _softmax(model.member_prior[cls], model.member_weights, members)
                for r in members:
                    _add_rows(member_part, r, q)
                    observed[1].append(r.astype(np.int32) * MEMBERS + cell % MEMBERS)
                for total, x in ((expected, part), (e, member_part)):  # a batch's sums are short enough for 32 bits
                    total += x
                    x.fill(0)
            seen, member_seen = (np.bincount(np.concatenate(found), minlength=x.size).reshape(x.shape) for found, x in zip(observed, (expected, e)))
            rows_on += seen.sum(axis=1, dtype=np.float32)
            members_on += member_seen.sum(axis=1, dtype=np.float32)
            mass += e
            step = RATE * (seen - expected) / (rows_on[:, None] * prior + SMOOTH)
            model.class_weights = np.clip(model.class_weights + step, -LARGEST, LARGEST).astype(np.float32)
            step = RATE * (member_seen - e) / (mass + SMOOTH)
            model.member_weights = np.clip(model.member_weights + step, -LARGEST, LARGEST).astype(np.float32)
    flat = np.concatenate([(model.class_weights * rows_on[:, None]).ravel(), rows_on, (model.member_weights * members_on[:, None]).ravel(), members_on]).reshape(-1, BLOCK)
    some = np.flatnonzero(flat.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([flat[i].tobytes() for i in some], pa.binary())], names=["block", "x"])


def _summed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.float64)
    for x in group["x"]:
        total += np.frombuffer(x, np.float32)
    return pd.DataFrame({"block": [key[0]], "x": [total.astype(np.float32).tobytes()]})


def train(chunks: DataFrame, cells: pd.DataFrame, tokens: int) -> Model:
    """Passes of gradient steps on the executors; only tables of fixed size (weights) reach the driver.

    The weights of a row are averaged over the tasks, each counting as often as it had the row on."""
    spark = chunks.sparkSession
    mass = np.ones(CELLS)
    mass[cells["cell"].to_numpy(int)] += cells["n"].to_numpy() + cells["v"].to_numpy()
    mass = mass.reshape(CLASSES, MEMBERS)
    prior = mass.sum(axis=1) / mass.sum()
    model = Model(np.log(prior).astype(np.float32), np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
                  np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32))
    source = chunks.select("train", "lens", "ids", "hashes").coalesce(max(1, -(-tokens // TASK)))
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(model)
        blocks = source.mapInArrow(lambda b, shared=shared: _steps(b, shared.value), "block int, x binary")
        flat = np.zeros((sum(SIZES) // BLOCK, BLOCK), np.float32)
        for r in blocks.groupBy("block").applyInPandas(_summed, "block int, x binary").collect():
            flat[r["block"]] = np.frombuffer(r["x"], np.float32)
        w, n, u, m = np.split(flat.ravel(), np.cumsum(SIZES)[:-1])
        model.class_weights = w.reshape(CLASS_ROWS, CLASSES) / np.maximum(n, 1)[:, None]
        model.member_weights = u.reshape(MEMBER_ROWS, MEMBERS) / np.maximum(m, 1)[:, None]
        shared.unpersist()
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model, cells: np.ndarray, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = ("docs", "train", "lens", "ids", "hashes", "known")
        for docs, learned, lens, ids, hashes, known in zip(*(batch.column(c).to_pylist() for c in columns)):
            chunk = Chunk(lens, ids, hashes)
            count = np.zeros(len(chunk.cells))
            if known:
                place, n = np.frombuffer(known, "<i8").reshape(2, -1)
                count[place] = n
            base = np.log10(count + 1) - np.log10(total + distinct + 1)
            word = np.log10(count + 1) - np.log10(cells[chunk.cells])
            score = np.empty(len(chunk.ids))
            order = np.argsort(chunk.last_row(np.arange(len(score))), kind="stable")
            for low in range(0, len(score), BATCH):
                at = order[low:low + BATCH]
                rows, members, cell = chunk.features(at)
                line = np.arange(len(at))
                p = _softmax(model.class_prior, model.class_weights, rows)[line, cell // MEMBERS]
                q = _softmax(model.member_prior[cell // MEMBERS], model.member_weights, members)[line, cell % MEMBERS]
                score[at] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
            score += word[chunk.ids]
            add = lambda x: np.add.reduceat(x, chunk.starts)  # noqa: E731  every text has a token, its end
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array([not x for x in learned]), pa.array(chunk.lens), pa.array(add((count > 0)[chunk.ids].astype(np.int64))),
                pa.array(np.full(len(docs), total)), pa.array(add(base[chunk.ids])), pa.array(add(score))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key (as doc_id), held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows where ``learn`` holds. Tokens are the words, A-Z lowered, and one end for each text; a null or empty text has
    the end alone. score: log10 of P(class | words before) P(member | class, words before) P(word | member), summed over the
    tokens. The first two are softmaxes over hashed n-gram and skip features; the last is the word's
    share in training, plus one, with one place for all unknown words, so the probabilities of all known words and of
    the unknown ones of each member add up to one. base_score: the plain word model with plus one.
    Nothing to learn from: all words are unknown, and the scores are those of even classes.

    Texts become token numbers once, in chunk rows with a vocabulary each; these are written, bucketed by chunk.
    Counts are summed over all chunks' vocabularies and joined back by word: a frequent word is there once for
    each chunk, not for each occurrence. Training goes over all learned texts
    ``PASSES`` times, a gradient step for each chunk. The rows of hashed features are of a fixed number, whatever the corpus.
    """
    spark = df.sparkSession
    source = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text).cast("binary").alias("text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = bucketed(source.mapInArrow(_tokens, TOKEN_SCHEMA), "tokens", "chunk", size)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("hashes", "counts"))):
                n = np.frombuffer(counts, "<u4")
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, "<i8")[some]), pa.array(n[some].astype(np.int64))], names=["h", "n"])

    counted = chunks.select("hashes", "counts").mapInArrow(vocabulary, "h long, n long")
    words = materialised(counted.groupBy("h").agg(F.sum("n").alias("n")), "words")
    cells = words.groupBy(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # CELLS rows at most
    total, distinct = int(cells["n"].sum()), int(cells["v"].sum())
    model = train(chunks, cells, total)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes"))):
                h = np.frombuffer(hashes, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), number)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], names=["chunk", "at", "h"])

    def gathered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "known": [np.stack([group["at"].to_numpy(np.int64), group["n"].to_numpy(np.int64)]).tobytes()]})

    known = chunks.select("chunk", "hashes").mapInArrow(places, "chunk long, at int, h long").join(words, "h").select("chunk", "at", "n") \
        .groupBy("chunk").applyInPandas(gathered, "chunk long, known binary")
    in_cell = np.ones(CELLS)
    in_cell[cells["cell"].to_numpy(int)] += cells["n"].to_numpy() + cells["v"].to_numpy()
    shared = spark.sparkContext.broadcast((model, in_cell))
    joined = chunks.join(known, "chunk", "left").select("docs", "train", "lens", "ids", "hashes", "known")
    return joined.mapInArrow(lambda b: _scores(b, *shared.value, total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 7) != 2)
