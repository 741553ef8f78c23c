"""Removal of repeated byte strings by a distributed merge sort of sparse suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import bucketed, table

#: Bytes of text that are handled together (a longer text is alone).
CHUNK = 4 << 20
#: Suffixes that one merge should see.
MERGE = 32_768
#: Grams that are sampled for each such merge, to cut the key space.
SAMPLE = 16
#: Length of the strings whose hash selects suffixes: the least of a window is selected.
GRAM = 32
#: Positions that are hashed at once.
STEP = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15

CHUNK_SCHEMA = "chunk long, docs array<long>, rids array<long>, lens array<long>, data binary"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes: differences of running polynomial sums."""
    n = len(data)
    if n < gram:
        return np.empty(0, np.uint64)
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        _POWERS[:] = [_powers(n, MULTIPLIER), _powers(n, inverse)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * _POWERS[1][: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(data: np.ndarray, room: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, hash, first, last) of selected places, in pieces.

    Every window of ``length`` bytes inside one document selects the places in it whose gram hash is least; ``first`` and
    ``last`` are the starts of the windows that selected a place. Equal windows select alike. room: bytes from each place to
    the end of its document.
    """
    width = length - gram + 1
    for at in range(0, len(data), STEP):
        low, high = max(0, at - width + 1), min(len(data), at + STEP + length + width)
        h = gram_hashes(data[low:high], gram)
        if len(h) < width:
            continue
        least = _sliding(h, width, np.minimum)
        least[room[low:low + len(least)] < length] = 0  # not inside one document: selects nothing
        padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        most = _sliding(padded, width, np.maximum)[: len(h)]
        place = np.flatnonzero((most == h) & (h != 0))
        place = place[(place + low >= at) & (place + low < at + STEP)]
        for part in np.array_split(place, len(place) // 16384 + 1):
            if len(part):
                windows = padded[part[:, None] + np.arange(width)] == h[part, None]
                first = part - width + 1 + windows.argmax(axis=1)
                last = part - windows[:, ::-1].argmax(axis=1)
                yield part + low, h[part], first + low, last + low


def _rooms(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes to the end of the document for each byte, and the documents' starts."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    room = np.repeat(ends.astype(kind), lens)
    room -= np.arange(total, dtype=kind)
    return room, ends - lens


def _each(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows of a batch one by one: chunks are large."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in columns)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed into rows of about ``CHUNK`` bytes."""
    part, seq = TaskContext.get().partitionId(), 0
    docs: list = []
    rids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def packed() -> pa.RecordBatch:
        nonlocal seq, held
        row = pa.RecordBatch.from_arrays([
            pa.array([(part << 24) + seq]), pa.array([docs], pa.list_(pa.int64())), pa.array([rids], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())],
            names=["chunk", "docs", "rids", "lens", "data"])
        seq, held = seq + 1, 0
        docs.clear(), rids.clear(), texts.clear()
        return row

    for batch in batches:
        for doc, rid, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "rid", "text"))):
            if texts and held + len(text or b"") > CHUNK:
                yield packed()
            docs.append(doc)
            rids.append(rid)
            texts.append(text or b"")
            held += len(texts[-1])
    if texts:
        yield packed()


def _gram_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(hash, chunk, whether it is there more than once, gram) for each distinct selected gram of a chunk; the gram itself only for a sample."""
    sampled = np.uint64(min(SAMPLE / MERGE, 1) * (2.0**64 - 2048))
    for batch in batches:
        for chunk, lens, text in _each(batch, "chunk", "lens", "data"):
            data = np.frombuffer(text, np.uint8)
            room, _ = _rooms(np.array(lens, np.int64))
            found = [(h, place) for place, h, _, _ in anchors(data, room, length)]
            places = np.concatenate([p for _, p in found] or [np.empty(0, np.int64)])
            h, at, n = np.unique(np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)]), return_index=True, return_counts=True)
            drawn = h * np.uint64(0xD6E8FEB86659FD93) <= sampled
            grams = [text[p:p + GRAM] if d else None for p, d in zip(places[at].tolist(), drawn.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.full(len(h), chunk)), pa.array(n > 1), pa.array(grams, pa.binary())], names=["h", "chunk", "again", "gram"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of h: those whose h is in several rows or several times in one. Holds the last h's rows only."""
    held: pa.Table | None = None

    def pick(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, again = rows["h"].to_numpy(), rows["again"].to_numpy()
        if len(h):
            same = h[1:] == h[:-1]
            keep = again | np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield from rows.filter(pa.array(keep)).select(["h", "chunk", "gram"]).combine_chunks().to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if len(rows):
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            held = rows.slice(cut)
            yield from pick(rows.slice(0, cut))
    if held is not None:
        yield from pick(held)


def _padded(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes read from each start, zero beyond each size."""
    at = np.arange(width)
    out = np.zeros((len(start), width), np.uint8)
    for n in range(0, len(start), 16384):
        place = np.clip(start[n:n + 16384, None] + step * at, 0, max(len(data) - 1, 0))
        out[n:n + 16384] = np.where(at < size[n:n + 16384, None], data[place], 0)
    return out


def _in_order(rows: np.ndarray, size: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Order of padded byte rows, shorter ones before their extensions; by ``first`` before that."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort((size, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), *first))


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row has in common with the one before; 0 for the first."""
    if not len(rows):
        return np.empty(0, np.int64)
    differ = rows[1:] != rows[:-1]
    least = np.minimum(size[1:], size[:-1])
    lcp = np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), least), least)
    return np.concatenate(([0], lcp))


RUN_SCHEMA = "part int, chunk long, cover boolean, n int, bytes int, packed binary"
#: Columns of a run in this order; then the strings' own bytes and those to their left.
COLUMNS = {"lcp": "<u1", "size": "<u1", "left_size": "<u1", "index": "<u4", "place": "<u8", "doc": "<i8", "tie": "<u4"}


def _row(part: int, chunk: int, cover: bool, columns: list[np.ndarray], tail: bytes = b"") -> tuple:
    """A run in a row. Numbers are laid out byte by byte, so that their many zero bytes compress."""
    names = ("index", "place", "doc") if cover else COLUMNS
    planes = [np.ascontiguousarray(x.astype(COLUMNS[c])).view(np.uint8).reshape(len(x), -1).T.tobytes() for c, x in zip(names, columns)]
    data = b"".join([*planes, tail])
    return part, chunk, cover, len(columns[0]), len(data), pa.compress(data, codec="zstd", asbytes=True)


def _unpack(row) -> tuple[list[np.ndarray], bytes]:
    data = pa.decompress(row.packed, decompressed_size=row.bytes, codec="zstd", asbytes=True)
    out, at = [], 0
    for c in (("index", "place", "doc") if row.cover else COLUMNS):
        kind = np.dtype(COLUMNS[c])
        end = at + row.n * kind.itemsize
        planes = np.frombuffer(data, np.uint8, end - at, at).reshape(kind.itemsize, row.n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))
        at = end
    return out, data[at:]


def _runs(batches: Iterator[pa.RecordBatch], length: int, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of a chunk's selected suffixes, one row for each part of the key range.

    Suffixes with equal surroundings in one chunk travel once, as the earliest; the others are known to repeat and
    make ``cover`` rows (index, place of the first byte and number of bytes).
    """
    names, types = zip(*(c.split() for c in RUN_SCHEMA.split(", ")))
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    for batch in batches:
        for chunk, docs, rids, lens, text, wanted in _each(batch, "chunk", "docs", "rids", "lens", "data", "wanted"):
            data, lens = np.frombuffer(text, np.uint8), np.array(lens, np.int64)
            room, starts = _rooms(lens)
            filled = np.flatnonzero(lens)
            wanted = np.sort(np.array(wanted, np.int64).view(np.uint64))
            numbers = np.array([np.iinfo(np.int64).max if d is None else d for d in docs], np.int64)
            rids = np.array(rids, np.int64) & 0xFFFFFFFF
            held: list[tuple[np.ndarray, ...]] = []
            rows = []

            def collapse(*found: np.ndarray) -> tuple[np.ndarray, ...]:
                """Keeps the earliest of equal surroundings (and its equals in key and text); the rest repeat."""
                right, left, size, left_size, doc, rid, index, inside = found
                rank = np.lexsort((inside, rid, doc))
                around = np.concatenate((right, left), axis=1)
                order = rank[_in_order(around[rank], size[rank] * 256 + left_size[rank])]
                around, both = around[order], (size * 256 + left_size)[order]
                same = np.concatenate(([False], (around[1:] == around[:-1]).all(axis=1) & (both[1:] == both[:-1])))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                own = np.stack([doc, rid, inside])[:, order]
                later = same & (own != own[:, head]).any(axis=0)
                if later.any():
                    at = order[later]
                    rows.append(_row(-1 - chunk % 1024, chunk, True, [index[at], inside[at] - left_size[at], left_size[at] + size[at]]))
                keep = order[~later]
                return tuple(x[keep] for x in found)

            for place, h, first, last in anchors(data, room, length):
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                keep = wanted[at] == h
                place, first, last = place[keep], first[keep], last[keep]
                if not len(place):
                    continue
                index = filled[np.searchsorted(starts[filled], place, side="right") - 1]
                size, left_size = last + length - place, place - first
                held.append(collapse(
                    _padded(data, place, size, length), _padded(data, place - 1, left_size, length - GRAM, -1), size, left_size,
                    numbers[index], rids[index], index, place - starts[index]))
            if not held:
                continue
            right, left, size, left_size, doc, rid, index, inside = collapse(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            order = np.arange(len(size))
            order = order[_in_order(right[order], size[order])]
            parts = _part_of(right[order][:, :GRAM], borders)
            for p in np.unique(parts):
                at = order[parts == p]
                lcp = _common(right[at], size[at])
                rest = b"".join([right[i, a:b].tobytes() for i, a, b in zip(at.tolist(), lcp.tolist(), size[at].tolist())])
                before = b"".join([left[i, :b].tobytes() for i, b in zip(at.tolist(), left_size[at].tolist())])
                rows.append(_row(int(p), chunk, False, [lcp, size[at], left_size[at], index[at], inside[at], doc[at], rid[at] & 0xFFFFFFFF], rest + before))
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), types)], names=list(names))


def _part_of(grams: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which part of the key range each gram falls into: number of borders not above it."""
    if not len(borders):
        return np.zeros(len(grams), int)
    both = np.concatenate((borders, grams))
    kind = np.concatenate((np.zeros(len(borders), int), np.ones(len(grams), int)))
    order = _in_order(both, kind)  # a border comes before equal grams
    below = np.cumsum(order < len(borders))
    out = np.empty(len(both), int)
    out[order] = below
    return out[len(borders):]


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, prefix shared with the one before) of all strings of sorted runs, in order.

    A loser tree whose nodes keep the loser's common prefix with the last winner. Of two candidates, the one
    with the longer such prefix is smaller, without a look at a byte; only where these are equal are bytes
    compared, and only those after the prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    texts = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    lcp = [0 if x else -1 for x in texts]  # -1: the run has ended
    loser = [0] * k

    def smaller(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then the one it shares with the winner."""
        x, y = lcp[a], lcp[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = texts[a][at[a]], texts[b][at[b]]
        u, v = s[x:], t[x:]
        n = min(len(u), len(v))
        bits = int.from_bytes(u[:n], "big") ^ int.from_bytes(v[:n], "big")
        shared = x + (n - (bits.bit_length() + 7) // 8)
        if u <= v:
            lcp[b] = shared
            return a, b
        lcp[a] = shared
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, lost = smaller(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return winner

    winner = build(1)
    while lcp[winner] >= 0:
        run, place = winner, at[winner]
        yield run, place, lcp[run]
        at[run] = place + 1
        lcp[run] = lcps[run][place + 1] if place + 1 < len(texts[run]) else -1
        node = (run + k) >> 1
        while node:
            winner, loser[node] = smaller(winner, loser[node])
            node >>= 1


def _decoded(lcp: list[int], size: list[int], rest: bytes) -> list[bytes]:
    """A front-coded run's strings."""
    out, at, last = [], 0, b""
    for a, b in zip(lcp, size):
        last = last[:a] + rest[at:at + b - a]
        at += b - a
        out.append(last)
    return out


def _merge(runs: pd.DataFrame, length: int) -> pd.DataFrame:
    """Windows of ``length`` bytes that start earlier elsewhere, as (chunk, index, place, bytes) to be removed."""
    rows = list(runs.sort_values("chunk").itertuples(index=False))
    if rows[0].cover:  # known already
        found = [np.stack([np.full(r.n, r.chunk), *_unpack(r)[0]]) for r in rows]
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["chunk", "index", "place", "bytes"]).astype({"index": np.int32})
    unpacked = [_unpack(r) for r in rows]
    columns = np.concatenate([np.stack(x) for x, _ in unpacked], axis=1)
    decoded, lefts = [], []
    for (lcp, size, *_), tail in unpacked:
        own = int((size - lcp).sum())
        decoded.append((_decoded(lcp.tolist(), size.tolist(), tail[:own]), lcp.tolist()))
        lefts.append(tail[own:])
    del unpacked
    n = sum(r.n for r in rows)
    merged = np.fromiter((x for three in merge_runs(decoded) for x in three), np.int64, 3 * n).reshape(n, 3)
    del decoded
    offset = np.cumsum([0, *[r.n for r in rows]])[:-1]
    at = offset[merged[:, 0]] + merged[:, 1]
    common = merged[:, 2]
    _, size, left_size, index, place, doc, tie = columns[:, at]
    chunk = np.repeat([r.chunk for r in rows], [r.n for r in rows])[at]
    sizes = columns[2]
    left = _padded(np.frombuffer(b"".join(lefts), np.uint8), (np.cumsum(sizes) - sizes)[at], left_size, length - GRAM)
    # Left contexts are compared only among suffixes whose first GRAM bytes agree.
    block = np.cumsum(common < GRAM)
    by_left = _in_order(left, left_size, block)
    left_common = _common(left[by_left], left_size[by_left])
    left_common[np.concatenate(([True], np.diff(block[by_left]) != 0))] = -1
    _, rank = np.unique(np.stack([doc, tie, place], axis=1), axis=0, return_inverse=True)
    rank = rank.reshape(-1)
    by_rank = np.argsort(rank, kind="stable")
    gone = np.zeros((n, length - GRAM + 1), bool)
    for o in range(length - GRAM + 1):  # windows that start o bytes before the suffix
        has = by_rank[(left_size[by_rank] >= o) & (size[by_rank] >= length - o)]
        if len(has) < 2:
            continue
        lid = np.empty(n, np.int64)
        lid[by_left] = np.cumsum(left_common < o)
        key = (np.cumsum(common < length - o) * (n + 1) + lid)[has]
        order = np.argsort(key, kind="stable")
        same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        ranks = rank[has][order]
        gone[has[order[ranks > ranks[head]]], o] = True
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)  # both in order of row, then offset
    return pd.DataFrame({"chunk": chunk[i], "index": index[i].astype(np.int32), "place": place[i] - (high - 1), "bytes": high - 1 - low + length})


def repeated_strings(df: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, spans): each row's text as UTF-8 bytes and the maximal spans of repeated bytes in it.

    spans: array of (start, end), end excluded: the bytes covered by a string of ``length`` bytes (33 to 255) that also starts
    earlier: in a row of smaller key (null last, ties by the text's hash), or before in the same text. Null texts are empty. Rows that agree in
    key and text are one document. Matches never cross documents; overlaps count; strings are judged on the input.

    Not all suffixes are sorted: each window of ``length`` bytes selects the places of least gram hash in it, so two
    equal windows select suffixes at equal places in them, and these are enough. (1) Texts are packed into chunks and written,
    bucketed by chunk, so later joins do not move texts. (2) Grams selected only once anywhere drop out: rows
    (hash, chunk) are sorted by hash, with at most one for each gram and chunk, however often it occurs.
    (3) Each chunk sorts its remaining suffixes and sends them in front-coded runs, cut at borders in the key space that come from a sample of
    all grams. (4) For each part the runs are merged by a loser tree that keeps common prefixes; those of the merged order,
    and of the bytes to the left, tell for each window where it occurred first. (5) Spans go back to their chunks.
    """
    if not GRAM < length < 256:
        raise ValueError(f"length must be {GRAM + 1} to 255")
    spark = df.sparkSession
    source = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(key).cast("long"), text).alias("rid"), F.col(text).cast("binary").alias("text"))
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = bucketed(source.mapInArrow(_chunks, CHUNK_SCHEMA), "chunks", "chunk", total)

    grams = chunks.select("chunk", "lens", "data").mapInArrow(lambda b: _gram_rows(b, length), "h long, chunk long, again boolean, gram binary")
    often = grams.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "h long, chunk long, gram binary")
    wanted = materialised(often.groupBy("chunk").agg(F.collect_list("h").alias("wanted"), F.collect_set("gram").alias("sampled")), "wanted")
    borders = spark.sparkContext.broadcast(_borders(wanted))
    runs = chunks.join(wanted.drop("sampled"), "chunk").mapInArrow(lambda b: _runs(b, length, borders.value), RUN_SCHEMA)
    covered = runs.groupBy("part").applyInPandas(lambda x: _merge(x, length), "chunk long, index int, place long, bytes long")
    spans = covered.groupBy("chunk").agg(F.collect_list(F.struct("index", "place", "bytes")).alias("cover"))
    return chunks.join(spans, "chunk", "left").mapInArrow(_cut, "key long, text binary, spans array<struct<start:long,end:long>>")


def _borders(wanted: DataFrame) -> np.ndarray:
    """Grams that cut the repeated grams about evenly into merges. As for any range partitioning, ``SAMPLE`` keys for each part reach the driver."""
    n = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    parts = -(-n // MERGE)
    found = sorted(r[0] for r in wanted.select(F.explode("sampled")).collect()) if parts > 1 else []
    chosen = sorted({bytes(found[len(found) * i // parts]) for i in range(1, parts)}) if found else []
    return np.frombuffer(b"".join(chosen), np.uint8).reshape(-1, GRAM)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' documents with the union of their spans."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            docs, lens, data = (batch.column(c)[row].as_py() for c in ("docs", "lens", "data"))
            lens = np.array(lens, np.int64)
            starts = np.cumsum(lens) - lens
            spans: list[list[dict]] = [[] for _ in docs]
            cover = batch.column("cover")[row].values
            if cover is not None and len(cover):
                index, place, size = (cover.field(i).to_numpy() for i in range(3))
                low = starts[index] + place
                order = np.lexsort((low, index))
                low, high, index = low[order], (low + size)[order], index[order]
                # Spans never leave their document, so a running maximum of the ends may run over all of them.
                reach = np.maximum.accumulate(high)
                new = np.concatenate(([True], (low[1:] > reach[:-1]) | (index[1:] != index[:-1])))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(low)])) - 1
                for i, a, b in zip(index[first].tolist(), low[first].tolist(), reach[last].tolist()):
                    spans[i].append({"start": a - int(starts[i]), "end": b - int(starts[i])})
            texts = [data[a:a + n] for a, n in zip(starts.tolist(), lens.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(span))], names=["key", "text", "spans"])


def without_spans(found: DataFrame) -> DataFrame:
    """``found`` with ``kept``: the bytes outside the spans, concatenated (maybe no valid UTF-8)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                at, out = 0, []
                for s in spans:
                    out.append(text[at:s["start"]])
                    at = s["end"]
                kept.append(b"".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=[*batch.schema.names, "kept"])

    return found.mapInArrow(run, "key long, text binary, spans array<struct<start:long,end:long>>, kept binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_spans(repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("key").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
