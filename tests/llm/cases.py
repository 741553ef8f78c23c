"""Small documents with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while eight grey geese fly south past old stone walls near our quiet river bank today".split()
GERMAN = "der schnelle braune fuchs springt weit über den faulen hund und zwölf graue gänse fliegen nach süden vorbei an alten mauern".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(words, n))


def lines(seed: int, n: int) -> str:
    return "\n".join(prose(seed * 1000 + i, 6) for i in range(n))


def documents() -> list[tuple]:
    """Nulls in each column, empty and wordless and very long texts, copies, near copies, repeated rows, odd characters."""
    shared = lines(77, 5)
    long = prose(5, 30_000)
    rows = [
        (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1), (3, prose(1, 60) + " end", "en", "b", 1),
        (4, lines(4, 3) + "\n" + shared + "\n" + lines(5, 2), "en", "a", 1), (5, lines(6, 2) + "\n" + shared, "en", "b", 1),
        (6, shared + "\n" + shared, "en", None, 1), (7, None, None, None, None), (8, "", "en", "a", 0), (9, " \t\n ", "de", "b", 3),
        (10, "12345 !!! 67", "en", "a", 5), (11, "short", "en", "c", 5), (12, long, "en", "c", 1), (13, long[:90_000], "en", "c", 1),
        (14, "a" * 2500, "en", "a", 1), (15, "naïve café \U0001f600 中文 <|endoftext|> x\x00y", None, "a", 1), (16, "\n\n\n\n\n\n", "en", "a", 1),
        (17, prose(9, 40, GERMAN), "de", "b", 1), (17, prose(9, 40, GERMAN), "de", "b", 1), (18, prose(9, 40, GERMAN), "de", "b", 1),
        (None, prose(3, 20), "en", "a", 1), (None, None, None, None, None),
    ]
    rows += [(100 + i, prose(100 + i, 30 + i % 7), "en", "abc"[i % 3], 1) for i in range(40)]
    rows += [(200 + i, prose(200 + i, 30 + i % 7, GERMAN), "de", "abc"[i % 3], 1) for i in range(40)]
    return rows


def lowered(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data))


def fingerprint(text: str | None, n: int = 4) -> int:
    words = lowered(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(n: int, linked) -> list[int]:
    """The smallest index reachable from each of n nodes."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def repeated_bytes(texts: list[str | None], length: int) -> list[list[tuple[int, int]]]:
    """Spans covered by strings that start earlier, for texts in order."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data) + 2)
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                gone[p + 1:p + 1 + length] = b"\1" * length
            seen.add(s)
        out.append([(m.start() - 1, m.end() - 1) for m in re.finditer(b"\1+", bytes(gone))])
    return out


def in_training(key, parts: int) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts != 2


def base_scores(rows: list[tuple], parts: int = 7):
    counts = Counter()
    tokens = [[*lowered(r[1]), None] for r in rows]
    for r, t in zip(rows, tokens):
        if in_training(r[0], parts):
            counts.update(t)
    total = sum(counts.values())
    return [(len(t), sum(counts[w] > 0 for w in t), sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)) for t in tokens], total
