"""Mixing sources to target weights, with DataFrame functions only.

1. A source's documents, in a fixed pseudorandom order, are one stream of words; blocks of ``block`` words cut it up.
2. Sources share ``total`` times all words by weight; no target is above ``most`` times its source's words, and what
   is cut off goes to the others by weight until none is above (closed form: sources sorted by the weight at which they
   reach their cap, and running sums).
3. Each output shard draws multinomial source counts, given the totals: the slots of the whole mix are numbered, a pseudorandom permutation
   maps them onto the numbers themselves, and the range of cumulative targets in which a number falls is the slot's source. So every shard's
   counts vary as drawn ones do, no draw is dropped, and totals meet the targets exactly.
4. The j-th slot of a source takes block perm(j mod blocks) of pass j div blocks, where perm is a pseudorandom
   permutation of block indices for that source and pass (swap-or-not rounds: a bijection for any number of blocks).
5. Slots join blocks by (source, block index). A block is taken at most ``most`` times, so no document exceeds that.

Everything that grows with the corpus is keyed by (source, bucket) or (source, block), so a source with most rows is
spread like any other, and is joined by shuffles, never broadcast. Only the table of sources (a row each) is ever sorted in one task. All draws are hashes of fixed seeds and indices: reruns agree.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source, last in order; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, settle, table

SEED = 20240917
ROUNDS = 12
GRID = 4096


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source (of ``source``, ``size``): words, weight and target words."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # A source is cut off at its cap once the common factor of all uncut weights reaches cap / weight.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    s = s.withColumn("cut", F.coalesce(F.sum("cap").over(by_ratio), zero)).withColumn("cut_weight", F.coalesce(F.sum("weight").over(by_ratio), zero))
    factor = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.col("cut")) / (F.sum("weight").over(everything) - F.col("cut_weight"))
    s = s.withColumn("factor", factor).withColumn("uncut", F.col("factor") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("uncut"), F.struct("cut_weight", "factor"))).over(everything).getField("factor")
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def laid_out(docs: DataFrame, block: int, per_bucket: int = 2_000) -> DataFrame:
    """Documents with their size and the position in their source's stream where they start."""
    sized = docs.select("doc_id", "source", _size(F.col("text")).alias("size"), F.xxhash64("text").alias("salt"))
    sized = settle(sized, "sizes")
    buckets = max(1, math.ceil(sized.count() / per_bucket))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "salt"), F.lit(buckets)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"))


def _permuted(index: Column, n: Column, source: Column, turn: Column, seed: int) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0..n-1: each round pairs x with key - x mod n, and a hash of
    the pair says whether its two members swap."""

    def round_(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit(seed), source, turn, r), n)
        other = F.pmod(key - x, n)
        return F.when(F.xxhash64(F.lit(seed + 1), source, turn, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, round_)


def slots(targets: DataFrame, block: int, per_shard: int = 65_536, least_shards: int = 16, seed: int = SEED) -> DataFrame:
    """The mix as rows (shard, source, turn, block): which block of which source each slot of each shard holds."""
    spark = targets.sparkSession
    t = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # The last block of a source may be short: a slot takes source_size / blocks words on average.
    t = t.withColumn("wanted", F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), 2 * F.col("blocks"))).otherwise(F.lit(0)))
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.where("wanted > 0").withColumn("high", F.sum("wanted").over(up_to)).withColumn("low", F.col("high") - F.col("wanted"))
    t = settle(t.select("source", "blocks", "wanted", "low", "high"), "shares")
    n_slots = t.agg(F.sum("wanted")).first()[0] or 0
    shards, width = max(least_shards, math.ceil(n_slots / per_shard)), max(1, math.ceil(n_slots / GRID))
    # Numbers meet the ranges of sources by a grid of cells, so that no key is hot.
    cells = t.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    number = _permuted(F.col("id"), F.lit(max(n_slots, 1)).cast("long"), F.lit("slots"), F.lit(0), seed)
    draws = spark.range(n_slots).select(F.pmod("id", F.lit(shards)).alias("shard"), number.alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    counts = draws.join(cells, "cell").where("u >= low AND u < high").groupBy("shard", "source").count()
    first = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("first", F.coalesce(F.sum("count").over(first), F.lit(0))), "counts")
    spans = counts.join(t.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).select("source", "blocks", "shard", "first", (F.col("first") + F.col("count")).alias("end"))
    # Few small rows stand for many slots: deal them out before they unfold.
    spans = spans.repartition(max(1, math.ceil(n_slots / 50_000)), "shard", "source")
    j = spans.select("source", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("j"))
    j = j.withColumn("turn", F.floor(F.col("j") / F.col("blocks")).cast("long"))
    return j.select("shard", "source", "turn", _permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("source"), F.col("turn"), seed).alias("block"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken): what the mix takes of each document."""
    placed = settle(laid_out(docs, block), "placed")
    targets = settle(source_targets(placed.select("source", "size"), weights, total, most), "targets")
    times = slots(targets, block).groupBy(F.col("source").alias("s"), F.col("block").alias("k")).agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = parts.withColumn("overlap", overlap).join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).groupBy("source", "start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    taken = taken.select(F.col("source").alias("s"), F.col("start").alias("at"), "taken")
    full = placed.where("size > 0").join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")), "left").drop("s", "at")
    out = full.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """The mix itself: rows (shard, source, turn, block, start, doc_id, words), in the order of ``start`` within a slot."""
    placed = laid_out(docs, block)
    targets = settle(source_targets(placed.select("source", "size"), weights, total, most), "targets")
    word = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("salt"), word.alias("words"))
    sized = placed.join(texts.dropDuplicates(["d", "salt"]).hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.size("words") == F.col("size")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = sized.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin, end = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("source", "block", begin.alias("start"), "doc_id", F.slice("words", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("words"))
    s = slots(targets, block).select("shard", F.col("source").alias("s"), "turn", F.col("block").alias("k"))
    return s.join(parts.hint("merge"), F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("block"))).select("shard", "source", "turn", "block", "start", "doc_id", "words")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
