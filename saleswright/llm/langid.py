"""Language ID: nearest of several clustered TF-IDF centroids for each language."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, remainder, table

#: Hashed n-gram buckets, and the lengths of the n-grams of characters.
BUCKETS = 4096
ORDERS = (1, 2, 3)
#: Most labelled texts that centroids are fitted on: for each language, and for all together.
SAMPLE_PER_LANGUAGE = 512
SAMPLE = 4096
CENTROIDS = 4
UNKNOWN = "und"
#: Borders of the histogram of training cosines, and the share of them below which a text may be far from a language.
BINS = 1000
FAR_SHARE = 0.001
#: A text is far if its cosine is below this part of what nearly all training texts reach. Very short clean
#: texts have few n-grams and so small cosines; they should stay.
FAR_PART = 0.25


def _character_table() -> np.ndarray:
    """For each code point its lower-case letter, or 32 (a space) if it is no letter or mark of one."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def letters_of(text: str | None) -> np.ndarray:
    """Lower-case letters, with one space between and around their runs."""
    if not _TABLE:
        _TABLE.append(_character_table())
    points = _TABLE[0][np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    space = points == 32
    return points[~(space & np.concatenate(([False], space[:-1])))]


def ngram_counts(text: str | None, step: int = 1 << 20) -> np.ndarray:
    """Counts of hashed n-grams of the whole text. A very long text is read in overlapping pieces."""
    points = letters_of(text)
    counts = np.zeros(BUCKETS, np.int64)
    if len(points) < 2:  # nothing but the one space
        return counts
    for at in range(0, len(points), step):
        part = points[at:at + step + max(ORDERS) - 1]
        for n in ORDERS:
            starts = min(step, len(part) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ part[k:k + starts]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (or zero): square root of the counts times idf."""
    out = np.stack([ngram_counts(t) for t in texts]).astype(np.float64) if texts else np.empty((0, BUCKETS))
    out = np.sqrt(out) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def cluster(rows: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows: spherical k-means from far-apart first centres."""
    centres = [rows.mean(axis=0)]
    while len(centres) < min(k, len(rows)):
        near = np.max(rows @ np.stack(centres).T, axis=1)
        centres.append(rows[int(near.argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(axis=1)
        c = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norm > 0, norm, 1)
    return c


@dataclass
class LanguageModel:
    languages: list[str]
    centroids: np.ndarray  # unit rows
    language_of: np.ndarray  # index of each centroid's language
    idf: np.ndarray
    floor: np.ndarray  # least cosine to count as near, for each language

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language index (-1: no letter) and cosine to its nearest centroid, for each text."""
        rows = vectors(texts, self.idf)
        has = rows.any(axis=1)
        if not len(self.centroids):
            return np.full(len(texts), -1), np.zeros(len(texts))
        cosine = rows @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        return np.where(has, self.language_of[best], -1), np.where(has, score, 0.0)


def _parts(column: pa.Array, rows: int = 128) -> Iterator[tuple[int, list]]:
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learns from the texts whose language is given.

    Document frequencies cover all training texts: each task gives one array of ``BUCKETS`` counts. The
    centroids are fitted on a sample of at most about ``SAMPLE_PER_LANGUAGE`` texts of a language and
    ``SAMPLE`` of all (chosen by a hash of the key; spread of a binomial), whose sparse vectors go to the
    driver. The floors cover all training texts again: for each language, the cosine that all but
    ``FAR_SHARE`` of its training texts reach, times ``FAR_PART``. No labelled text: no language.
    """
    spark = train.sparkSession
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.empty((0, BUCKETS)), np.empty(0, int), np.ones(BUCKETS), np.empty(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen += ngram_counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), -1]), pa.array([*seen.tolist(), n])], names=["b", "n"])

    counted = labelled.select(text).mapInArrow(frequencies, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in counted}
    idf = np.log((1 + found[-1]) / (1 + np.array([found[b] for b in range(BUCKETS)]))) + 1

    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(languages)))
    share = F.create_map(*[F.lit(x) for x in sum(([k, min(1.0, each / n)] for k, n in sizes.items()), [])])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(29), key), 11) / F.lit(float(1 << 53))
    sample = labelled.where(draw < share[F.col(lang)]).select(lang, text)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _parts(batch.column(1)):
                rows = vectors(texts, idf)
                places = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)),
                    pa.array([p.astype(np.int16).tobytes() for p in places], pa.binary()),
                    pa.array([r[p].astype(np.float32).tobytes() for r, p in zip(rows, places)], pa.binary())], names=["lang", "at", "x"])

    by_language: dict[str, list[np.ndarray]] = {}
    for r in sample.mapInArrow(sparse, "lang string, at binary, x binary").collect():
        row = np.zeros(BUCKETS)
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["x"], np.float32)
        if row.any():
            by_language.setdefault(r["lang"], []).append(row)
    learned = [k for k in languages if by_language.get(k)]
    centres = [cluster(np.stack(sorted(by_language[k], key=lambda x: x.tobytes()))) for k in learned]
    model = LanguageModel(
        learned, np.concatenate(centres) if centres else np.empty((0, BUCKETS)),
        np.concatenate([[i] * len(c) for i, c in enumerate(centres)]).astype(int) if centres else np.empty(0, int), idf, np.zeros(len(learned)))

    shared = spark.sparkContext.broadcast(model)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = np.zeros((len(m.languages), BINS), np.int64)
        for batch in batches:
            own = np.array([m.languages.index(x) if x in m.languages else -1 for x in batch.column(0).to_pylist()])
            for at, texts in _parts(batch.column(1)):
                which, score = m.nearest(texts)
                right = (which == own[at:at + len(texts)]) & (which >= 0)
                np.add.at(seen, (which[right], np.minimum((score[right] * BINS).astype(int), BINS - 1)), 1)
        i, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(seen[i, b])], names=["i", "b", "n"])

    seen = np.zeros((len(learned), BINS))
    for r in labelled.select(lang, text).mapInArrow(spread, "i long, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).collect():
        seen[r["i"], r["b"]] = r["n"]
    total = seen.sum(axis=1, keepdims=True)
    reach = (np.cumsum(seen, axis=1) > FAR_SHARE * total).argmax(axis=1) / BINS
    model.floor = np.where(total[:, 0] > 0, reach * FAR_PART, 0.0)
    return model


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``.

    Only the whole text counts. Null, or without a letter: ``und``, score 0, rejected. A text is rejected, too,
    if its cosine is below the floor of its nearest language: it is far from all that was learned. Ties go
    to the language first in order. Columns of these names are replaced, all others kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c.lower() not in new]
    work = free_name(df, "_text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for at, texts in _parts(batch.column(work)):
                which, score = m.nearest(texts)
                far = (which < 0) | (score < np.append(m.floor, 1.0)[which])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, len(texts)) for c in kept],
                     pa.array(names[which].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*kept, *new])

    return df.select(*kept, df[text].alias(work)).mapInArrow(run, schema + "lang_pred string, score double, rejected boolean")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
