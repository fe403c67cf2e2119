"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only. An item is contained in a document if at least ``percent`` of its distinct word shingles are among
the document's. Plain MinHash compares sets as wholes and can't see a short item inside a document a thousand times its
size, so the sketch is of the item alone:

1. Items are partitioned by set size, in powers of two. The sketch of an item is its bottom MinHash values (its shingles
   with the smallest hashes), as many as its partition needs: one more than an item of that partition may miss. A
   document that contains the item has at least one of them, so the search loses nothing.
2. A document's shingle hashes are looked up among the sketch values, only in partitions whose items are small enough to be
   contained in it.
3. Candidates are verified on the shingles themselves, all of the item's against all of the document's.

The sketch table grows with the benchmark, not the corpus. It is broadcast while it has at most ``broadcast_rows`` values
(16 bytes each); beyond that both sides are shuffled by hash. The items' shingles at verification are broadcast while their texts, once for each word
of a shingle, have at most ``broadcast_bytes``; beyond that candidates are shuffled by item. In shuffles a common shingle or item is a plain
equi-join's key, which Spark splits where it is skewed.

Defined cases: null and empty texts and items match nothing; a text of fewer words than a shingle is one shingle, so a shorter
item is found only as a whole text; repeated rows give their pair once; null ids are reported as null; other columns, and
clashing names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, settle, table, words


def _shingles(text: Column, width: int, make) -> Column:
    """An array with ``make(words)`` for each run of ``width`` words; one for the whole text if it has fewer."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: make([F.element_at(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, runs).when(F.size(w) > 0, F.array(make([F.array_join(w, " ")])))

    return F.element_at(F.transform(F.array(words(lower_ascii(text))), of), 1)


def _hashes(text: Column, width: int) -> Column:
    return _shingles(text, width, lambda parts: F.xxhash64(*parts))


def _strings(text: Column, width: int) -> Column:
    return F.array_distinct(_shingles(text, width, lambda parts: F.concat_ws(" ", *parts)))


def _row_key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(id_column, text_column)


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (item, least, hash): the bottom values of each item; ``least`` is how many shingles a document needs at least."""
    i = items.select("item", F.array_sort(F.array_distinct(_hashes(F.col("item_text"), width))).alias("h")).where("size(h) > 0")
    i = i.withColumn("low", F.pow(F.lit(2), F.length(F.bin(F.size("h").cast("long"))) - 1).cast("long"))  # the partition has sizes low to 2 * low - 1
    most = 2 * F.col("low") - 1
    i = i.withColumn("n", most - F.ceil(most * percent / 100) + 1)
    return i.select("item", F.ceil(F.col("low") * percent / 100).alias("least"), F.explode(F.slice("h", F.lit(1), F.least(F.col("n").cast("int"), F.size("h")))).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 75, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment): items contained in documents. Its ``doc_key`` tells rows apart."""
    items = settle(benchmark.select("item_id", F.col("text").alias("item_text")).distinct().withColumn("item", _row_key("item_id", "item_text")), "items")
    sketch = settle(sketches(items, width, percent), "sketches")
    texts = docs.select("doc_id", "text").withColumn("doc_key", _row_key("doc_id", "text"))

    small = sketch.count() <= broadcast_rows
    light = (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) * width <= broadcast_bytes
    hashed = texts.select("doc_key", _hashes(F.col("text"), width).alias("h"))
    looked = hashed.select("doc_key", F.size("h").alias("size"), F.explode("h").alias("hash")).join(F.broadcast(sketch) if small else sketch, "hash")
    candidates = settle(looked.where("size >= least").select("doc_key", "item").distinct(), "candidates")

    strings = items.select("item", "item_id", _strings(F.col("item_text"), width).alias("wanted"))
    pairs = texts.join(candidates, "doc_key").join(F.broadcast(strings) if light else strings, "item")
    pairs = pairs.withColumn("n_item", F.size("wanted").cast("long")).withColumn("n_shared", F.size(F.array_intersect("wanted", _strings(F.col("text"), width))).cast("long"))
    pairs = pairs.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return pairs.select("doc_key", "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    bad = settle(contained(docs, benchmark, **options).select(F.col("doc_key").alias("contained_key")).distinct(), "contaminated")
    return docs.join(bad, _row_key("doc_id", "text") == F.col("contained_key"), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_item", "n_shared", "containment")


_GRAMS = """(SELECT DISTINCT {id}, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM (SELECT {id}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table}))"""
ORACLE = f"""
WITH d AS {_GRAMS.format(id="doc_id", table="documents")}, b AS {_GRAMS.format(id="item_id", table="benchmark")},
n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item"""
