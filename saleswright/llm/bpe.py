"""Byte-level BPE encoding and decoding: distinct words in a trie, walked once, shared prefixes encoded once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

# Fixed value: the pattern by which byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker keeps the words of two generations of at most so many: those that recur move on, the others are forgotten.
CACHED_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes words by the last token of each prefix.

    A sequence of tokens is what the merges give if and only if each token alone and each two neighbours are
    what the merges give for their bytes. So the encoding of a prefix ends with the one token t for which
    (last token of the prefix without t, t) is such a pair, and encodings are chains of last tokens.
    """

    def __init__(self, definition: str):
        model = json.loads(definition)
        if model.get("normalizer") or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normalizer or added space is asked for")
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.ids = {to_bytes(t): i for t, i in vocabulary.items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Of each token the rank of its last merge and the two parts it joined; bytes have no merge.
        self.born: dict[bytes, int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        #: Tokens that the merges give for their own bytes; others never occur.
        self.reached = {t for t in self.ids if self.learn_history(t)}
        #: Ends of tokens: no token ends with anything else.
        self.ends = {t[i:] for t in self.reached for i in range(len(t))}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn_history(self, token: bytes) -> bool:
        """Whether the merges give the token for its bytes; keeps its last merge."""
        if len(token) == 1:
            self.born[token] = -1
            return True
        *_, last = self.merges_of(token)
        if len(last) != 2 or (last[0], last[1]) not in self.rank:
            return False
        self.born[token], self.parts[token] = self.rank[last[0], last[1]], (last[0], last[1])
        return True

    def merges_of(self, data: bytes) -> Iterator[list[bytes]]:
        """The parts before each merge, lowest rank first, leftmost first, and what is left before the last one or without any."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            best = min(((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(len(self.rank), 0))
            yield parts
            if best[0] == len(self.rank) or len(parts) == 2:
                return
            at = best[1]
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether the merges keep the border between two tokens.

        Backward in time, the later of the two last merges beside the border is undone. In between, the two parts at
        the border stood side by side; had their own merge come before the one undone, the border would be gone. Of
        equal ranks the leftmost merge comes first: the border's before one on its right, but behind one on its left.
        """
        rank, born, parts = self.rank, self.born, self.parts
        limit = len(rank)
        while True:
            if rank.get((before, token), limit) < limit:
                return False
            left, right = born[before], born[token]
            if left > right:
                limit, before = left, parts[before][1]
            elif right >= 0:
                limit, token = right + 1, parts[token][0]
            else:
                return True

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, from a depth-first walk of the trie of all words.

        In sorted order, the words' paths are the depth-first walk: ``last[i]`` is the last token of the
        current path's first i bytes; going on to the next word keeps the states of the shared prefix.
        """
        last: list[bytes] = [b""]
        path = b""
        ids, reached, ends, fits = self.ids, self.reached, self.ends, self.fits
        for word in sorted(set(words)):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                found = [b""]
                for at in range(end - 1, -1, -1):
                    token = word[at:end]
                    if token not in ends:
                        break
                    if token in reached:
                        found.append(token)
                token = found.pop()
                while token and len(token) < end and not fits(last[end - len(token)], token):
                    token = found.pop()
                if not token:
                    raise ValueError(f"byte {word[end - 1]} is not in the vocabulary")
                last.append(token)
            path = word
            tokens, at = [], len(word)
            while at:
                tokens.append(ids[last[at]])
                at -= len(last[at])
            yield word, tokens[::-1]

    def learn(self, words: set[str]) -> None:
        """Makes all of ``words`` known; those of the last generation that recur are taken over."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.older, self.words = self.words, {}
            new = words
        for w in new.intersection(self.older):
            self.words[w] = self.older[w]
        for word, ids in self.walk(w.encode() for w in new.difference(self.older)):
            self.words[word.decode()] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text; a special token's string is its id."""
        if not self.specials:
            return self.split.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.split.findall(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split.findall(text[at:] if at else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, one after the other."""
        split = [self.pieces(t) for t in texts]
        self.learn({w for pieces in split for w in pieces if w.__class__ is str})
        known = self.words
        special = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        return [b"".join([known[w] if w.__class__ is str else special[w] for w in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_BUILT: dict[str, ByteBPE] = {}


def encoder(definition: str) -> ByteBPE:
    """One encoder for each worker process."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = ByteBPE(definition)
    return _BUILT[key]


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``, the text the ids stand for.

    tokenizer: path of a byte-level BPE definition; the driver reads it once and sends it to the executors
    (a vocabulary of fixed size). The words of each batch of texts that a worker has not seen form a trie;
    words it has seen are kept up to ``CACHED_WORDS``. Null texts count as empty: no ids, decoded to an empty
    text. Very long texts and words are encoded whole, in time linear in their length. Special tokens' strings
    become their ids. Columns that are called like the new ones are replaced; no shuffle takes place.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_definition(tokenizer))
    new = {"ids", "n_tokens", "decoded"}
    kept = [c for c in df.columns if c.lower() not in new]
    work = free_name(df, "_text")
    source = df.select(*[df[c] for c in kept], df[text].alias(work))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for whole in batches:
            for batch in _slices(whole, work, batch_bytes):
                texts = [t or "" for t in batch.column(work).to_pylist()]
                ids = bpe.encode(texts)
                columns = [batch.column(c) for c in kept]
                columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "n_tokens", "decoded"])

    return source.mapInArrow(run, f"{schema}{', ' * bool(schema)}ids binary, n_tokens long, decoded string")


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece has about ``most`` bytes of text, or one row."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(column).to_pylist()])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))
