"""SimHash near-duplicates found through deletion variants of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import LOWER, components, free_name, local_roots, smallest_reachable, table

#: Fingerprints with one variant in common are compared in groups of at most about twice this many.
BLOCK = 4096
#: So many links are folded into components at once, to bound memory.
LINKS = 1 << 20
#: Two texts at a Jaccard similarity of 0.8 differ in 19 of the 128 bits of two fingerprints on average (deviation 4), strangers in 64.
WITHIN = 30
#: Bytes of shingle sets that a block of texts holds when they are compared exactly.
ROOM = 8 << 20


def fingerprint_of(text: bytes | None, shingle: int, seed: int) -> int:
    """Signed 64-bit SimHash: bit set if it is in over half of the hashes of the word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())), "<u8", len(starts))
    return fingerprint_of_hashes(hashes)


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes (<u8); of none: zero."""
    count, at = np.zeros(64, np.int64), 0
    while at < len(hashes):  # in steps, so that a very long text needs no more memory
        part = hashes[at:at + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += len(part)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def two_fingerprints(hashes: np.ndarray) -> tuple[int, int]:
    """The SimHash of hashes (<u8), and that of the hashes mixed once more."""
    mixed = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return fingerprint_of_hashes(hashes), fingerprint_of_hashes((mixed ^ mixed >> np.uint64(31)).astype("<u8"))


def with_fingerprints(df: DataFrame, columns: Sequence[str], text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``columns`` of ``df`` and ``fingerprint`` (long) of each whole text. Null or no words: zero."""
    work = free_name(df, "_bytes")
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns) + "fingerprint long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t, shingle, seed) for t in batch.column(work).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(prints, pa.int64())], names=[*columns, "fingerprint"])

    return df.select(*columns, df[text].cast("binary").alias(work)).mapInArrow(run, schema)


def _variant_keys(fingerprint: Column, distance: int) -> list[Column]:
    """Keys that two fingerprints at ``distance`` or fewer bits have at least one of in common.

    The 64 bits are cut into distance // 2 + 1 segments, so the bits that differ leave one segment with at
    most one of them. For each bit of each segment there is one key: the segment without that bit.
    """
    segments = distance // 2 + 1
    borders = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for low, high in zip(borders, borders[1:]):
        for bit in range(low, high):
            mask = ((1 << high) - (1 << low)) & ~(1 << bit)
            mask -= (1 << 64) * (mask >> 63)
            rest = F.shiftrightunsigned(fingerprint.bitwiseAND(F.lit(mask).cast("long")), low)
            keys.append(F.xxhash64(F.lit(bit), rest) if high - low > 32 else rest + F.lit(bit << 32))
    return keys


def variants(fingerprint: Column, distance: int) -> Column:
    """The keys of :func:`_variant_keys` as one array."""
    return F.array(*_variant_keys(fingerprint, distance))


def near_links(prints: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at ``distance`` or fewer bits do.

    ``prints`` has distinct ``id`` (long). Every fingerprint is indexed under its variants; those under one
    key are brought together by a shuffle on the key and compared exactly. A key with more than ``block``
    of them is cut into blocks by a hash and each pair of blocks is a group of its own, so no task
    holds more than two blocks, and no pair is left out. A task gives out only what connects its groups, less
    than one link for each member, never all pairs.
    """
    keyed = prints.select("id", F.explode(variants(F.col("id"), distance)).alias("k"))
    return _dealt(keyed, block).mapInArrow(lambda batches: _compare(batches, distance), "a long, b long")


def wide_links(nodes: DataFrame, distance: int = 8, within: int = WITHIN, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (id long, unique; f and g, two independent fingerprints) that may be alike.

    A pair is a candidate if f or g have a variant for ``distance`` in common. It is linked if f or g alone differ in
    ``distance`` or fewer bits, which is what :func:`near_links` finds for each of them, or else if they together differ in ``within``
    or fewer of their 128 bits, whatever the segments. Else as :func:`near_links`.
    """
    keys = F.array(*_variant_keys(F.col("f"), distance), *[k.bitwiseXOR(F.lit(-1 << 63)) for k in _variant_keys(F.col("g"), distance)])
    keyed = nodes.select("id", "f", "g", F.explode(keys).alias("k"))
    return _dealt(keyed, block).mapInArrow(lambda batches: _compare(batches, within, ("f", "g"), distance), "a long, b long")


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """``keyed`` (id, k and more) with i and j, in groups of (k, i, j) that lie together."""
    columns = [c for c in keyed.columns if c != "k"]
    large = materialised(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
                         .select(F.col("k").alias("hot"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")), "large")
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    if large.isEmpty():
        grouped = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        joined = keyed.join(large, F.col("k") == F.col("hot"), "left").withColumn("own", own)
        grouped = joined.withColumn("g_", F.explode(F.when(F.col("hot").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs))).select(*columns, "k", "g_.i", "g_.j")
    return grouped.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").select("k", "i", "j", *columns)


def _compare(batches: Iterator[pa.RecordBatch], distance: int, prints: Sequence[str] = ("id",), alone: int = -1) -> Iterator[pa.RecordBatch]:
    """Links between ids of one group whose ``prints`` together differ in ``distance`` or fewer bits, or one of them in ``alone`` or fewer."""
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(3 + len(prints))]
    links: list[np.ndarray] = []
    found = 0

    def folded() -> pa.RecordBatch:
        ends = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        roots = nodes[local_roots(len(nodes), at[0], at[1])]
        other = roots != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], names=["a", "b"])

    def compare(key: np.ndarray, group: np.ndarray, ids: np.ndarray, *bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal found
        at, step = np.arange(len(ids)), 0
        while len(at):  # each with the one that is ``step`` further on, while that is in the same group
            step += 1
            at = at[at + step < len(ids)]
            at = at[(key[at] == key[at + step]) & (group[at] == group[at + step])]
            differ = [np.bitwise_count((x[at] ^ x[at + step]).view(np.uint64)) for x in bits]
            near = at[(sum(differ) <= distance) | (np.minimum.reduce(differ).astype(np.int64) <= alone)]
            if len(near):
                links.append(np.stack([ids[near], ids[near + step]]))
                found += len(near)
            if found > LINKS:
                yield folded()
                links.clear()
                found = 0

    for batch in batches:
        new = [batch.column("k").to_numpy(), (batch.column("i").to_numpy().astype(np.int64) << 32) + batch.column("j").to_numpy(), *[batch.column(c).to_numpy() for c in ("id", *prints)]]
        key, group, *rest = (np.concatenate(x) for x in zip(held, new))
        if not len(key):
            continue
        # The last group may go on in the next batch.
        cut = int(np.flatnonzero((key != key[-1]) | (group != group[-1]))[-1]) + 1 if (key[0] != key[-1] or group[0] != group[-1]) else 0
        held = [key[cut:], group[cut:], *[x[cut:] for x in rest]]
        yield from compare(key[:cut], group[:cut], *[x[:cut] for x in rest])
    yield from compare(*held)
    if links:
        yield folded()


def simhash_groups(
    df: DataFrame, text: str = "text", key: str = "doc_id", tie: str | None = None, shingle: int = 4, distance: int = 4, seed: int = 42,
) -> DataFrame:
    """One row (key, fingerprint long, component) for each row of ``df``.

    component: the smallest key reachable through fingerprints that differ in ``distance`` or fewer bits.
    Null, empty and wordless texts have fingerprint zero and link like any other. Null keys come after all
    others, so a component is null only if all its keys are. Rows with equal keys keep one row each. With ``tie`` (a column), the result
    also has ``first``: whether the row has the least (key, tie) of its component.
    Equal fingerprints are one node, so copies cost nothing beyond their own rows.
    """
    columns = [key, *([tie] if tie else [])]
    prints = materialised(with_fingerprints(df, columns, text, shingle, seed), "fingerprints")
    order = F.struct(F.col(key).isNull().alias("none"), *[F.col(c) for c in columns])
    nodes = materialised(prints.groupBy(F.col("fingerprint").alias("id")).agg(F.min(order).alias("value")), "nodes")
    links = near_links(nodes.select("id"), distance)
    reached = materialised(smallest_reachable(nodes, links).select(F.col("id").alias("fingerprint_"), "component"), "reached")
    joined = prints.join(reached, F.col("fingerprint") == F.col("fingerprint_"))
    leads = [F.col("component")[tie].alias("lead"), order.eqNullSafe(F.col("component")).alias("first")] if tie else []
    return joined.select(*columns, "fingerprint", F.col("component")[key].alias("component"), *leads)


def shingle_set(text: str | None, shingle: int, seed: int) -> bytes:
    """Sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return b""
    digest = xxhash.xxh64_intdigest
    many = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + shingle]), seed) for i in range(many)), "<u8", many)).tobytes()


def _alike(one: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Which of the sets in ``codes`` (numbers below ``n``, set by set, none empty) have that Jaccard similarity to ``one``."""
    flag = np.zeros(n, np.int64)
    flag[one] = 1
    both = np.add.reduceat(flag[codes], starts)
    return both >= similarity * (len(one) + sizes - both)


def verified(sets: list[bytes], similarity: float, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of sets of hashes at ``similarity`` or more; two empty sets are alike.

    Those marked in ``joined`` are known to hang together and start as one. A set that is reached is not compared again
    with those reached before, so a heap of like sets takes one pass, and only sets that are not alike make pairs.
    """
    sizes = np.array([len(x) // 8 for x in sets])
    values, codes = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
    borders = np.concatenate(([0], np.cumsum(sizes)))
    links = []
    empty = np.flatnonzero(sizes == 0)
    links += [(int(empty[0]), int(x)) for x in empty[1:]]
    todo = list(np.flatnonzero(joined & (sizes > 0))) if joined is not None else []
    left = np.setdiff1d(np.flatnonzero(sizes > 0), todo)
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        held = np.concatenate([codes[borders[i]:borders[i + 1]] for i in left]) if len(left) else codes[:0]
        found = np.zeros(len(left), bool)
        starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1])).astype(np.int64)
        while todo and len(left) and not found.any():
            at = todo.pop()
            found = _alike(codes[borders[at]:borders[at + 1]], held, starts, sizes[left], len(values), similarity)
        if found.any():
            links += [(int(at), int(x)) for x in left[found]]
            todo += list(left[found])
            left = left[~found]
    return links


def _teams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, hung, own) of each group (team, i, j) of rows that come in order of it; single rows are left out."""
    now, held = None, ([], [], [])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for *group, id_, hung, own in zip(*[part.column(c).to_pylist() for c in ("team", "i", "j", "id", "hung", "own")]):
                if group != now:
                    if len(held[0]) > 1:
                        yield held
                    now, held = group, ([], [], [])
                for x, v in zip(held, (id_, hung, own)):
                    x.append(v)
    if len(held[0]) > 1:
        yield held


def verified_links(nodes: DataFrame, sets: DataFrame, similarity: float, room: int = ROOM) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs of one ``team`` at Jaccard ``similarity`` or more do.

    ``nodes``: id (long, unique), team, value (its order); ``sets``: id, own (hashes). A team whose sets take up to ``room`` bytes
    is compared in one task. The sets of a larger one are compared with the set of its least value first; those that are
    alike hang together already, and only the others are compared with them and with each other, in pairs of blocks of about ``room`` bytes.
    """
    members = materialised(nodes.join(sets, "id").select("team", "id", "value", "own"), "members")
    size = F.length("own") + F.lit(64)
    large = materialised(members.groupBy("team").agg(F.sum(size).alias("bytes"), F.min_by("id", "value").alias("lead"))
                         .where(F.col("bytes") > room).select("team", "lead"), "large_teams")
    out = "a long, b long"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hung, own in _teams(batches):
            found = np.array(verified(own, similarity, np.array(hung, bool)), int).reshape(-1, 2)
            ids = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])
        pa.default_memory_pool().release_unused()  # the worker stays while stages without Python run

    def compared(groups: DataFrame) -> DataFrame:
        return groups.repartition("team", "i", "j").sortWithinPartitions("team", "i", "j").select("team", "i", "j", "id", "hung", "own").mapInArrow(inside, out)

    zero = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("hung")]
    if large.isEmpty():
        return compared(members.select("team", "id", "own", *zero))
    small = members.join(large.select("team"), "team", "left_anti").select("team", "id", "own", *zero)
    first = large.join(members.select(F.col("id").alias("lead"), F.col("own").alias("other")), "lead").select("team", "lead", "other")

    def like_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [x == y or bool(verified([x, y], similarity)) for x, y in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("team", "id", "lead", "own")], pa.array(near, pa.bool_())], names=["team", "id", "lead", "own", "hung"])

    kind = members.schema["team"].dataType.simpleString()
    star = materialised(members.join(first, "team").select("team", "id", "lead", "own", "other").mapInArrow(
        like_first, f"team {kind}, id long, lead long, own binary, hung boolean"), "star")
    blocks = star.groupBy("team").agg(*[F.ceil(F.coalesce(F.sum(F.when(c, size)), F.lit(0)) / F.lit(room)).cast("int").alias(n) for c, n in ((F.col("hung"), "near"), (~F.col("hung"), "far"))])
    dealt = star.join(blocks.where("far > 0"), "team")
    draw = F.xxhash64(F.lit(5), "id")
    own = F.when(F.col("hung"), F.pmod(draw, F.col("near"))).otherwise(F.col("near") + F.pmod(draw, F.greatest("far", F.lit(1)))).cast("int")
    other = F.sequence(F.when(F.col("hung"), F.col("near")).otherwise(F.lit(0)), F.col("near") + F.col("far") - 1)
    pairs = dealt.withColumn("block", own).withColumn("with", F.explode(other)).select(
        "team", "id", "own", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "hung")
    return (compared(small).unionByName(compared(pairs)).unionByName(star.where("hung and id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))))


def keep_one(
    df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, distance: int = 8, similarity: float = 0.8, seed: int = 42,
) -> DataFrame:
    """``df`` without near-duplicates: of each group the row of least key stays (null keys last, ties by a hash of the row).

    Texts of equal sets of distinct word shingles are one node with two fingerprints. Nodes that a chain of :func:`wide_links`
    connects are compared with each other, all pairs (:func:`verified_links`), and groups are the components over those pairs
    whose Jaccard similarity is at least ``similarity``. So what only chance has put near stays, and copies go whatever else is near them.
    Wordless and null texts are alike, so one of them stays. Of rows equal in all columns one stays. Columns are unchanged.
    """
    tie = free_name(df, "_tie")
    rows = df.withColumn(tie, F.xxhash64(*df.columns))
    brief = rows.select(F.col(key).alias("key"), F.col(tie).alias("t"), F.col(text).cast("string").alias("text"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints = [], []
            for x in batch.column("text").to_pylist():
                found = shingle_set(x, shingle, seed)
                digests.append(xxhash.xxh3_128_digest(found))
                prints.append(two_fingerprints(np.frombuffer(found, "<u8")))
            f, g = (pa.array([p[n] for p in prints], pa.int64()) for n in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), pa.array(digests, pa.binary()), f, g], names=["key", "t", "digest", "f", "g"])

    kind = df.schema[key].dataType.simpleString()
    order = F.struct(F.col("key").isNull().alias("none"), "key", "t")
    marked = materialised(brief.mapInArrow(marks, f"key {kind}, t long, digest binary, f long, g long"), "marks")
    nodes = materialised(marked.groupBy("digest").agg(F.min(order).alias("value"), F.first("f").alias("f"), F.first("g").alias("g"))
                         .withColumn("id", F.monotonically_increasing_id()), "nodes")
    near = components(wide_links(nodes.select("id", "f", "g"), distance))
    teams = materialised(nodes.join(near.withColumnRenamed("root", "team"), "id"), "teams")
    involved = teams.select("team", "id", "value")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, shingle, seed) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "own"])

    # Merge joins at every size: a broadcast that ends at some size would turn into a shuffle of texts.
    texts = brief.join(involved.select("id", F.col("value.t").alias("t")).hint("merge"), "t").select("id", "text")
    shingles = texts.mapInArrow(sets, "id long, own binary").dropDuplicates(["id"])
    links = verified_links(involved, shingles, similarity)
    reached = materialised(smallest_reachable(nodes.select("id", "value", "digest"), links).select("digest", "component"), "reached")
    lost = marked.join(reached, "digest").where(~order.eqNullSafe(F.col("component")))
    gone = materialised(lost.select(F.col("t").alias(tie)).distinct(), "gone").hint("merge")
    again = materialised(marked.groupBy(F.col("t").alias(tie)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(tie), "again")
    kept = rows.join(gone, tie, "left_anti")
    if again.isEmpty():
        return kept.select(*df.columns)
    once = kept.join(again, tie, "left_semi").dropDuplicates([tie])
    return kept.join(again, tie, "left_anti").unionByName(once).select(*df.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
