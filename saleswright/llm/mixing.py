"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import materialised
from .common import free_name, table, unit, word_count

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: (source, n, source_size, target).

    ``sizes`` has source and size. Sources in code-point order, null last, get the weights in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. That sharing is a single level: target = min(cap, level x weight), and the level is
    found by ordering sources by cap/weight and running sums, not by a loop.
    Only one row for each source passes through the windows.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = by_source.withColumn("_i", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") + 1))
    everything = Window.partitionBy()
    capped = (
        listed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    rank = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = capped.withColumn("_rank", F.row_number().over(rank)).withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # The first source in this order whose cap is above the level, and all after it, are not capped.
    chosen = levels.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return chosen.select("source", "n", "source_size", target.alias("target"))


def pivotal_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    seed: int = 7, block: int = 96, size: Column | None = None, source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """``docs`` with source_size, target and copies: how often the mix takes each row.

    A row's expected copies are target / source_size (2 at most); the whole part is certain, the fraction is
    rounded by pivots. Two fractional rows of one source are paired and words are moved between them, at
    random in the direction that leaves both expectations as they were, until one is 0 or 1; the other goes
    on to the next pair. So a source's expected words stay the same at every step, up to the very last row.
    The pairs form a reduction tree: rows are dealt by a seeded hash into blocks of about ``block``, a block is folded
    to one row that is still fractional, and those rows are dealt and folded again, until one is left for
    each source; it is rounded at random. No group ever holds more than a block, whatever a source's share.

    size: words of ``text`` unless given; null counts as 0. Rows of size 0 move no words and are rounded on
    their own. A source is a value of the column, null is one too. All columns are kept; a column called
    source_size, target, copies or size is replaced. The choice depends on (seed, key, size, source) alone, so reruns
    agree; rows that agree in key, size and source share a block. Empty input gives no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("source_size", "target", "copies", "size")]
    sized = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs[source].alias("source"), docs[key].alias("key"),
                        (F.coalesce(size.cast("long"), F.lit(0).cast("long")) if size is not None else word_count(docs["text"])).alias("size"))
    targets = materialised(source_targets(sized.select("source", "size"), weights, share, most), "targets")
    n = targets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    facts = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0))
    # One row for each source: small enough to be broadcast as measured, joined by sort otherwise.
    rows = sized.join(facts.select(F.col("source").alias("s"), "n", "source_size", "target", "rate"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor("rate")
    rows = rows.withColumn("tag", F.xxhash64(F.lit(seed), "key", "size", "source")).withColumn("whole", whole)
    fraction = F.col("rate") - F.col("whole")
    loose = rows.withColumn("part", F.when(F.col("size") > 0, fraction).otherwise(
        (unit(seed + 1, "tag") < fraction).cast("double"))).drop("rate")
    settled, level = [], 0
    while n:
        deal = F.pmod(F.xxhash64(F.lit(seed + 100 + level), "tag"), F.greatest(F.ceil(F.col("n") / F.lit(block)), F.lit(1)))
        item = F.struct("tag", "key", "part", "size", "whole", "source_size", "target", "row")
        groups = loose.withColumn("deal", deal).groupBy("source", "n", "deal").agg(F.array_sort(F.collect_list(F.struct(
            "tag", F.struct("part", "size").alias("p"), item.alias("item")))).alias("items"))
        brief = F.transform("items", lambda x: F.struct(x["tag"], x["p"]["part"].alias("part"), x["p"]["size"].cast("double").alias("size")))
        folded = groups.withColumn("folded", _fold(brief, seed + 1000 * (level + 1)))
        out = folded.select("source", "n", F.explode(F.arrays_zip("items", F.col("folded.parts").alias("x"))).alias("z")).select(
            "source", "n", "z.items.item.*", F.col("z.x").alias("x"))
        out = materialised(out.drop("part").withColumnRenamed("x", "part"), "folded")
        done = (F.col("part") <= 0) | (F.col("part") >= 1)
        settled.append(out.where(done).withColumn("copies", F.col("whole") + (F.col("part") >= 1).cast("long")))
        loose = out.where(~done).withColumn("n", F.ceil(F.col("n") / F.lit(block)))
        if n <= 1:
            settled.append(loose.withColumn("copies", F.col("whole") + (unit(seed + 2, "tag") < F.col("part")).cast("long")))
        n, level = (-(-n // block) if n > 1 else 0), level + 1
    if not settled:  # no rows
        settled.append(loose.withColumn("copies", F.col("whole")))
    result = None
    for part in settled:
        part = part.select("row.*", "size", "source_size", "target", "copies")
        result = part if result is None else result.unionByName(part)
    return result


def _fold(items: Column, seed: int) -> Column:
    """Folds (tag, part, size) items from the left, one pivot at a time; ``parts`` are the items' new parts.

    The fold carries the place, part, size and tag of the pivot. Meeting an item, words move until one of both is
    integral. Its list is written once per step: (place, part) of the one that was settled; at the end the
    list is put in order of place, with the last pivot in it.
    """
    eps = 1e-12
    start = F.struct(
        F.lit(-1).alias("at"), F.lit(0.0).alias("part"), F.lit(1.0).alias("size"), F.lit(0).alias("i"),
        F.expr("cast(array() as array<struct<at:int,part:double>>)").alias("done"))

    def clean(x: Column) -> Column:
        return F.when(x < eps, 0.0).when(x > 1 - eps, 1.0).otherwise(x)

    def step(acc: Column, x: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), x["tag"], acc["i"]), 11) / F.lit(float(1 << 53))
        s, z = acc["size"], x["size"]
        up = F.least((1 - acc["part"]) * s, x["part"] * z)    # words the pivot can take from the item
        down = F.least(acc["part"] * s, (1 - x["part"]) * z)  # words it can give
        moved = F.when(u * (up + down) < down, up).otherwise(-down)
        z = F.greatest(z, F.lit(1.0))
        p, q = clean(acc["part"] + moved / s), clean(x["part"] - moved / z)
        return F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), lambda m: F.when(
            (x["part"] <= 0) | (x["part"] >= 1),  # nothing to round
            F.struct(acc["at"].alias("at"), acc["part"].alias("part"), s.alias("size"), (acc["i"] + 1).alias("i"),
                     F.array_append(acc["done"], F.struct(acc["i"].alias("at"), x["part"].alias("part"))).alias("done")),
        ).when(
            acc["at"] < 0,
            F.struct(acc["i"].alias("at"), x["part"].alias("part"), z.alias("size"), (acc["i"] + 1).alias("i"), acc["done"].alias("done")),
        ).when(
            (m["p"] <= 0) | (m["p"] >= 1),  # the pivot is settled; the item goes on
            F.struct(acc["i"].alias("at"), m["q"].alias("part"), z.alias("size"), (acc["i"] + 1).alias("i"),
                     F.array_append(acc["done"], F.struct(acc["at"].alias("at"), m["p"].alias("part"))).alias("done")),
        ).otherwise(
            F.struct(acc["at"].alias("at"), m["p"].alias("part"), s.alias("size"), (acc["i"] + 1).alias("i"),
                     F.array_append(acc["done"], F.struct(acc["i"].alias("at"), m["q"].alias("part"))).alias("done")),
        ))[0]

    def finish(acc: Column) -> Column:
        last = F.struct(acc["at"].alias("at"), acc["part"].alias("part"))
        full = F.array_sort(F.when(acc["at"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], last)))
        return F.struct(F.transform(full, lambda d: d["part"]).alias("parts"))

    return F.aggregate(items, start, step, finish)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as ``copies`` says."""
    at = free_name(mixed, "_copy")
    return mixed.where("copies > 0").withColumn(at, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(at)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = pivotal_mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
