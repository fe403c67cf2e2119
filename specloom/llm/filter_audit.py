"""Filter interaction audit: how filters of documents act alone, after each other and in every order.

A text is read once, by a transducer over its UTF-8 bytes: two tables, indexed by state and byte, give the next state and what the byte
means (a word begins or ends, a capital, a code point, a symbol). The state after a byte depends on the byte alone, so a
block's states are one look-up and a shift. Words leave the transducer as spans and are put into a hash table by a
rolling hash of the block; a span that meets an entry with its hash is compared with it byte by byte, and probes on if they differ, so
distinct words are exact. Slices of about ``BLOCK`` bytes are read at once; a longer text is read block by block into one table,
which holds its distinct words.

Equal texts are found by SHA-256. Documents shrink to counts by text, part, failed filters and labels before anything is
gathered by text, so a large group of copies is a few rows. Orders and steps unfold from the counts of failed sets, at most 32 for each part.

Defined cases: a null text is the empty text; a null part is the empty string; a row without an id repeats no text and is no original; rows with
the same id and text don't repeat each other; a label counts if any of a document's label rows holds it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, table

BLOCK = 2 << 20
BEGINS, ENDS, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Next state (0 between words, 1 in a word) and output, by state and byte.
STEP = np.tile((~_BLANK).astype(np.uint8), (2, 1))
EMIT = np.zeros((2, 256), np.uint8)
EMIT[0, ~_BLANK] |= BEGINS
EMIT[1, _BLANK] |= ENDS
EMIT[:, 65:91] |= CAPITAL
EMIT[:, [not 128 <= b < 192 for b in range(256)]] |= POINT
EMIT[:, list(b"#$%&*|")] |= SYMBOL
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes (modulo 2^64) of spans of ``data``."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + 1) * _powers(_BASE, len(data)))])
    back = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    out = (total[end] - total[start]) * back[start]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bytes_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]


class WordTable:
    """Open addressing over (owner, word); entries keep their bytes for verification."""

    def __init__(self):
        self.data, self.owner, self.start, self.length, self.code = np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)

    def insert(self, data: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, keep: bool) -> np.ndarray:
        """Whether each span is a new word of its owner. ``keep``: later calls compare with these words."""
        old, here = len(self.owner), len(self.data)
        owner, start, length, code = np.concatenate([self.owner, owner]), np.concatenate([self.start, start + here]), np.concatenate([self.length, end - start]), np.concatenate([self.code, code])
        data = np.concatenate([self.data, data]) if here else data
        size = 1 << max(4, int(2 * len(owner)).bit_length())
        slots, spot = np.full(size, -1, np.int64), ((code ^ (owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB))) >> np.uint64(13)).astype(np.int64) & (size - 1)
        new, waiting = np.zeros(len(owner), bool), np.arange(len(owner))
        while len(waiting):
            free = waiting[slots[spot[waiting]] < 0]
            slots[spot[free[::-1]]] = free[::-1]  # the first that asks for a slot gets it
            there = slots[spot[waiting]]
            new[waiting[there == waiting]] = True
            waiting, there = waiting[there != waiting], there[there != waiting]
            like = (owner[waiting] == owner[there]) & (length[waiting] == length[there]) & (code[waiting] == code[there])
            a, b, n = start[waiting[like]], start[there[like]], length[waiting[like]]
            differs = np.add.reduceat((_bytes_of(data, a, n) != _bytes_of(data, b, n)).astype(np.int64), np.cumsum(n) - n) > 0 if len(n) else np.zeros(0, bool)
            on = ~like
            on[np.flatnonzero(like)[differs]] = True
            waiting = waiting[on]
            spot[waiting] = (spot[waiting] + 1) & (size - 1)
        if keep:
            self.data, self.owner, self.length, self.code = _bytes_of(data, start[new], length[new]), owner[new], length[new], code[new]
            self.start = np.cumsum(self.length) - self.length
        return new[old:]


def _read(data: np.ndarray, ends: np.ndarray, words: WordTable, keep: bool) -> np.ndarray:
    """Counts (words, distinct words that ``words`` hasn't, capitals, code points, symbols) of texts that each end in a blank which is not theirs."""
    state = np.concatenate([np.zeros(1, np.uint8), STEP[0][data[:-1]]])
    flags = EMIT.ravel()[state.astype(np.int64) << 8 | data]
    begin, end = np.flatnonzero(flags & BEGINS), np.flatnonzero(flags & ENDS)
    owner = np.searchsorted(ends, begin, "right")
    new = words.insert(data, owner, begin, end, codes(data, begin, end), keep)
    starts = np.concatenate([[0], ends[:-1]])
    per = lambda bit: np.add.reduceat((flags & bit > 0).astype(np.int64), starts)
    return np.stack([np.bincount(owner, minlength=len(ends)), np.bincount(owner[new], minlength=len(ends)), per(CAPITAL), per(POINT) - 1, per(SYMBOL)], axis=1)


def read_texts(texts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """A row of counts for each text."""
    out = np.zeros((len(texts), 5), np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= block):
            size += len(texts[j]) + 1
            j += 1
        if size <= block + 1:
            data = np.frombuffer(b" ".join([*texts[i:j], b""]), np.uint8)
            out[i:j] = _read(data, np.cumsum([len(t) + 1 for t in texts[i:j]]), WordTable(), False)
        else:
            words, whole, at = WordTable(), np.frombuffer(texts[i], np.uint8), 0
            while at < len(whole):
                to = min(at + block, len(whole))
                while to < len(whole) and not _BLANK[whole[to - 1]]:  # blocks end behind a blank: no word is in two
                    blank = np.flatnonzero(_BLANK[whole[to : to + block]])
                    to = to + int(blank[0]) + 1 if len(blank) else min(to + block, len(whole))
                out[i] += _read(np.append(whole[at:to], np.uint8(32)), np.array([to - at + 1]), words, True)[0]
                at = to
        i = j
    return out


COUNTS = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, digest) of documents (doc_id, text, part)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            size = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1])
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // (4 * BLOCK))) + 1).tolist(), len(column)]
            for a, b in itertools.pairwise(cuts):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.slice(a, b - a)]
                counts = read_texts(texts)
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("part").slice(a, b - a), *(pa.array(c) for c in counts.T), digests], ["doc_id", "part", *COUNTS, "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(lean(read), "doc_id long, part string, " + ", ".join(f"{c} long" for c in COUNTS) + ", digest binary")


#: The five filters, by letter: what fails. E, the repetition of an earlier text, is found from digests.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 3 * n_points", "D": "n_symbols > 0"}
REPEATS = "E"


def failures(measured: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """Documents by (part, failed): how many there are (n), with good and with toxic labels. ``failed``: the letters of the filters a document
    fails; ``labels``: rows (doc_id, quality, toxic)."""
    failed = F.concat(*(F.when(F.expr(rule), F.lit(letter)).otherwise(F.lit("")) for letter, rule in filters.items()))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("bad"))
    marks = marks.where("good OR bad").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    no = F.lit(False)
    rows = measured.select("doc_id", "part", failed.alias("failed"), "digest").join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "bad": F.coalesce("bad", no)})
    kind = ["digest", "part", "failed", "good", "bad"]
    rows = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("c"))
    # Of each kind: all rows, those without an id, and the first id with its rows.
    rows = rows.groupBy(*kind).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("first"))
    rows = rows.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    fine = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    each = F.array(F.struct(F.col("failed"), fine.alias("n")), F.struct(F.concat("failed", F.lit(REPEATS)).alias("failed"), (F.col("n") - fine).alias("n")))
    rows = rows.select("part", "good", "bad", F.inline(each)).where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return rows.groupBy("part", "failed").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("bad").alias("n_toxic"))


def audit(failed: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step; ``failed`` as from ``failures``."""
    orders = ",".join("".join(p) for p in itertools.permutations(letters))
    rows = failed.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = rows.withColumns({"letter": F.expr("substring(filter_order, step, 1)"), "before": F.expr("substring(filter_order, 1, step - 1)")})
    rows = rows.withColumns({"fails": F.expr("locate(letter, failed) > 0"), "gone": F.expr("translate(failed, before, '') <> failed")})
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    now: Column = F.col("fails") & ~F.col("gone")
    rows = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"), total(now).alias("removed"), total(F.col("fails") & F.col("gone")).alias("redundant"), total(F.col("failed") == F.col("letter")).alias("unique_fails"),
        total(now, "n_good").alias("good_lost"), total(now, "n_toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("part"))
    return audit(failures(measure(docs), table(spark, sf_dir, "labels")), "".join(FILTERS) + REPEATS)


_ORDERS = ", ".join("('" + "".join(p) + "')" for p in itertools.permutations("ABCDE"))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
o AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT w.doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text))::INT
    + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > o.least, false)::INT AS fails FROM w JOIN o ON w.text = o.text),
l AS (SELECT doc_id, coalesce(max(quality = 1), false)::INT AS good, coalesce(max(toxic = 1), false)::INT AS bad FROM labels GROUP BY doc_id),
h AS MATERIALIZED (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(bad), 0) AS t FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
p AS (SELECT * FROM (VALUES {_ORDERS}) x(filter_order)),
s AS MATERIALIZED (SELECT filter_order, k::INT AS step, 1 << (ascii(filter_order[k]) - 65) AS bit, list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(filter_order[j]) - 65)))::INT AS earlier FROM p, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & coalesce(earlier, 0) > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & bit > 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost
    FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
