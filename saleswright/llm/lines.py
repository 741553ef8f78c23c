"""Line dedup: later repeats of runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import WORD, free_name, table

#: A run of so many lines counts as repeated, whatever they hold.
RUN = 3
#: A run of fewer lines counts if it holds so many words.
WORDS = 50


def line_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.encode()) for x in text.split("\n")], np.uint64)


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``run`` lines the place of its least hash, the last one of equals."""
    if len(hashes) < run:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return np.arange(len(windows)) + run - 1 - windows[:, ::-1].argmin(axis=1)


def window_hashes(hashes: np.ndarray, run: int) -> np.ndarray:
    """One 64-bit hash of each window's line hashes, in their order."""
    h = np.full(max(0, len(hashes) - run + 1), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(run):
        h = (h ^ hashes[i:i + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def counted_windows(text: str, run: int, words: int) -> tuple[np.ndarray, ...]:
    """The line hashes, then place, start, size and hash of the windows that count: ``run`` lines, or fewer with ``words`` words; by place.

    The place is that of the line the window selects; windows of each size are winnowed on their own.
    """
    hashes = line_hashes(text)
    held = np.cumsum([0, *(len(x.split()) for x in text.encode().split(b"\n"))])  # bytes are split at ASCII space alone
    parts = []
    for size in range(1, min(run, len(hashes)) + 1):
        start = np.arange(len(hashes) - size + 1)
        if size < run:
            start = np.flatnonzero(held[size:] - held[:-size] >= words)
        if len(start):
            parts.append((winnow(hashes, size)[start], start, np.full(len(start), size), window_hashes(hashes, size)[start]))
    if not parts:
        return (hashes, *[np.empty(0, np.int64)] * 4)
    columns = [np.concatenate(c) for c in zip(*parts)]
    by_place = np.argsort(columns[0], kind="stable")
    return hashes, *[c[by_place] for c in columns]


def _positions(batches: Iterator[pa.RecordBatch], run: int, words: int) -> Iterator[pa.RecordBatch]:
    """A row for each selected place: document, place, line hash, and the windows (start, size, hash) that selected it."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        sizes = [0]
        for at, text in enumerate(batch.column("text").to_pylist()):
            hashes, chosen, start, size, window = counted_windows(text or "", run, words)
            if not len(chosen):
                continue
            places, first = np.unique(chosen, return_index=True)
            for column, values in zip(columns, (np.full(len(places), at), places, hashes[places], start, size, window)):
                column.append(values)
            sizes += np.diff([*first, len(chosen)]).tolist()
        doc, place, fp, start, size, window = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
        windows = pa.StructArray.from_arrays(
            [pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(window.astype(np.uint64).view(np.int64))], names=["start", "size", "window"])
        rows = pa.array(doc.astype(np.int64))
        yield pa.RecordBatch.from_arrays([
            batch.column("rid").take(rows), batch.column("doc").take(rows), pa.array(place.astype(np.int32)), pa.array(fp.astype(np.uint64).view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), windows)], names=["rid", "doc", "place", "fp", "windows"])


def repeated_runs(df: DataFrame, run: int = RUN, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(rid, runs): for each text with repeats, the sorted (start, size) of its windows that occur earlier.

    rid is :func:`row_id`. Earlier: in a document of smaller key (null keys last, ties by the text's hash), or before in the same text.
    Windows are of ``run`` lines, or of fewer with ``words`` words: a run of equal lines that has either is
    covered by them, so one line of that many words is enough.

    Every window selects the line of least hash in it (winnowing; a line alone selects itself), so two equal runs
    always select equal lines at equal places. Selected lines that occur once are dropped. From the others,
    matches are extended to both sides, over the windows that selected the line, by comparing the windows' hashes; the earliest place of
    each window is found by a minimum (combined before the shuffle) and joined back, so a line in a third of
    all documents makes one row for each occurrence, not one for each pair. Overlapping windows add up to runs of any length.
    """
    source = df.select(row_id(df, key, text).alias("rid"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    places = materialised(source.mapInArrow(
        lambda b: _positions(b, run, words), "rid long, doc long, place int, fp long, windows array<struct<start:int,size:int,window:long>>"), "places")
    shared = materialised(places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "shared")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "rid", "start")
    same = ["fp", "size", "window"]
    found = materialised(places.join(shared, "fp").select("rid", "doc", "fp", F.explode("windows").alias("w")).select("rid", "doc", "fp", "w.*"), "windows")
    first = materialised(found.groupBy(same).agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").drop("last"), "first")
    later = found.join(first, same).where(order > F.col("first"))
    return later.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("runs"))


def row_id(df: DataFrame, key: str, text: str):
    """Stands for (key, text): equal rows have one result."""
    return F.xxhash64(df[key].cast("long"), df[text])


def _without(batches: Iterator[pa.RecordBatch], kept: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, spans = [], []
        for t, runs in zip(batch.column(text).to_pylist(), batch.column("_runs").to_pylist()):
            if not runs:
                out.append(t)
                spans.append([])
                continue
            lines = t.split("\n")
            gone = np.zeros(len(lines) + 2, np.int8)
            for r in runs:
                gone[r["start"] + 1:r["start"] + r["size"] + 1] = 1
            edge = np.flatnonzero(np.diff(gone))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            out.append("\n".join([x for x, g in zip(lines, gone[1:]) if not g]))
        columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept]
        removed = pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64())
        lines_in = pa.array([0 if t is None else t.count("\n") + 1 for t in batch.column(text).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, lines_in, removed, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*kept, "n_lines", "n_removed", "removed"])


def dedup_lines(df: DataFrame, run: int = RUN, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with repeated lines cut out of ``text``; n_lines, n_removed and removed (spans of lines, end excluded) are added.

    Lines are what newlines separate, compared as they are. A line goes if it lies in consecutive lines that also occur earlier and are
    ``run`` or more, or hold ``words`` words (what is not ASCII space) or more (see :func:`repeated_runs`); the first occurrence
    stays. Judged on the input, not on what is left. No row is dropped: a text of which nothing is left is empty. Null texts stay
    null with no lines; an empty table gives an empty one; a text of any length is read whole, in one piece. Rows that agree in key and text are one document and do not
    delete each other. Columns called like the new ones are replaced.
    """
    new = ("n_lines", "n_removed", "removed", "_runs")
    kept = [c for c in df.columns if c.lower() not in new]
    runs = repeated_runs(df, run, words, text, key)
    rid = free_name(df, "_rid")
    # The runs grow with the input: a merge join at every size, so that no broadcast turns into a shuffle of all texts later.
    found = materialised(runs.select(F.col("rid").alias(rid), F.col("runs").alias("_runs")), "runs").hint("merge")
    joined = df.select(*kept, row_id(df, key, text).alias(rid)).join(found, rid, "left").select(*kept, "_runs")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)
    return joined.mapInArrow(lambda b: _without(b, kept, text), schema + "n_lines long, n_removed long, removed array<struct<start:int,end:int>>")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _window_sql(size: int) -> str:
    """Windows of so many lines, and what they must hold to count."""
    block = " || chr(10) || ".join(f"lead(line, {k}) OVER o" for k in range(size))
    words = " + ".join(f"lead(words, {k}) OVER o" for k in range(size))
    return f"""
  SELECT doc_id, i, {size} AS size, block FROM (
    SELECT doc_id, i, {block} AS block, {words} AS words FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE block IS NOT NULL AND words >= {WORDS if size < RUN else 0}"""


OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '{WORD}')) AS words FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
w AS ({" UNION ALL ".join(_window_sql(size) for size in range(1, RUN + 1))}),
later AS (
  SELECT doc_id, i, size FROM (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, block ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(size)) AS k FROM later)),
marked AS (
  SELECT l.*, g.i IS NOT NULL AS gone, coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)"""
