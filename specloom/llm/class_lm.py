"""Language-model scores from a class-based bigram model whose word classes come from exchange clustering.

p(word | word before) = p(class | class before) * p(word | class); the end of a text is a token with a class of its own, and
is what stands before the first word. Word classes:

1. Seeds: words with at least 1 / ``share`` of all training tokens (so at most ``share`` words) are clustered by the exchange algorithm in
   one task: words move one at a time to the class that raises the likelihood of their class bigrams most, until a sweep moves none.
2. Rounds of exchange over the whole training vocabulary, the seeds included, until it settles: what stands before and after each word is summed over the
   corpus as counts of (word, neighbour class, side), and every word moves to the class that raises the likelihood most against
   the table of all class pairs. In the first round neighbours are seeds, later all words. Words that move at once can spoil each other's gain, so after the first round
   half of the words (by hash) moves in turn. A round that lowers the likelihood is undone; when two in a row gain less than ``least_gain`` of
   the log likelihood, the best classes are the result. Each other round gains, and the likelihood is bounded, so this ends.

A class depends on sums over the corpus only, never on how texts are dealt. The number of classes grows with the cube root of the vocabulary, so the
table of class pairs grows more slowly than the vocabulary and stays small.

Class transitions and emissions are then counted over all training tokens. Transitions are smoothed by adding to counts; within its
class a known word has its share of the class's tokens. An unseen word gets the base model's probability of one, and the
class before it stays the context.

Scale: texts are encoded once, in the order of the scan, in batches of about ``batch_bytes``; words are 64-bit hashes, and the vocabulary is cut into
parts by ranges of the hash, about ``per_part`` words of batches each. A part and a batch exchange packed numbers: classes of the batch's distinct
words one way, sparse sums the other. So tokens are never shuffled by word. The sums of seeds, which every batch has, go through a plain
aggregation with partial sums instead; they are at most ``share`` * (2 * classes + 1) numbers, and so they meet on the driver.

Defined cases: null and empty texts are the end token alone; without training rows all tokens are unknown; repeated rows
are scored (and learned from) each; a null id counts as the empty text for the split; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, cycle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, give_back, lean, pieces, remainder, settle, split_words, table

END = "\n"  # no word contains white space


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words and end tokens of all texts in order, dictionary-encoded, and where each text starts (one more entry than texts)."""
    flat, starts = split_words(texts)
    n = len(texts)
    at = np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(starts))
    take = np.full(len(flat) + n, len(flat), np.int64)
    take[at] = np.arange(len(flat))
    both = pa.concat_arrays([flat.cast(pa.large_string()), pa.array([END], pa.large_string())])
    return both.take(pa.array(take)).dictionary_encode(), starts + np.arange(n + 1)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _before(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The code before each token; ``end`` before the first of a text."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[starts[:-1]] = end
    return out


def _blob(x: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes: all first bytes, then all second ones and so on, compressed."""
    x = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _read(cell, kind: str) -> np.ndarray:
    """The numbers of a binary cell (null: none)."""
    raw = cell.as_buffer() if isinstance(cell, pa.Scalar) else cell
    if raw is None or not len(raw):
        return np.empty(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


def _merged(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text from smaller and larger ones."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, "text", limit):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


ENCODED = "batch long, words long, h binary, n binary, codes binary, starts binary, doc_id array<long>, held_out array<boolean>"


def encoded_batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """A row per batch of rows (doc_id, text, held_out): its distinct words as sorted hashes ``h`` with their counts ``n`` in training rows, its tokens
    as places in these, where texts start, and the texts' columns."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(_merged(batches, batch_bytes)):
            if not t.num_rows:
                continue
            coded, starts = tokens(t.column("text"))
            h = np.fromiter(map(word_hash, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            order = np.argsort(h)
            place = np.empty(len(h), np.int32)
            place[order] = np.arange(len(h), dtype=np.int32)
            codes = place[coded.indices.to_numpy(zero_copy_only=False)]
            train = np.repeat(~t.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts))
            yield pa.RecordBatch.from_arrays([
                pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([len(h)]), *(pa.array([x], pa.binary()) for x in (_blob(h[order], "<u8"), _blob(np.bincount(codes[train], minlength=len(h)), "<u4"), _blob(codes, "<i4"), _blob(starts, "<i4"))),
                *(pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c)) for c in ("doc_id", "held_out")),
            ], ["batch", "words", "h", "n", "codes", "starts", "doc_id", "held_out"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(lean(encode), ENCODED)


class Tokens:
    """The tokens of a batch; words are places among its distinct ones."""

    def __init__(self, row):
        cell = lambda c: row.column(c).combine_chunks()[0] if isinstance(row, pa.Table) else row.column(c)[0]
        self.cell, self.codes, self.starts = cell, _read(cell("codes"), "<i4"), _read(cell("starts"), "<i4").astype(np.int64)
        self.held_out = cell("held_out").values.to_numpy(zero_copy_only=False).astype(bool)

    def bigrams(self, words: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training bigrams (a, b, n), given the number of distinct words and the place of the end token."""
        train = np.repeat(~self.held_out, np.diff(self.starts))
        pair, times = np.unique((_before(self.codes, self.starts, end).astype(np.int64) * words + self.codes)[train], return_counts=True)
        return pair // words, pair % words, times


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _places(cell) -> np.ndarray:
    return np.cumsum(_read(cell, "<i4"))


def _cuts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array, and where each starts (one more entry)."""
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    return part[cut], np.append(cut, len(part))


#: A row (batch WORDS) with a part's hashes and counts, and for each batch (its number) where its words of this part are among them.
VOCABULARY, WORDS, KINDS = "part long, batch long, a binary, n binary, tokens long, known long", -2, -1


def vocabulary(encoded: DataFrame, parts: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                h, n = _read(rows.column("h")[k], "<u8"), _read(rows.column("n")[k], "<u4")
                part, cut = _cuts(_part_of(h, parts))
                hs, ns = ([_blob(x[i:j], kind) for i, j in zip(cut[:-1], cut[1:], strict=True)] for x, kind in ((h, "<u8"), (n, "<u4")))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), rows.column("batch")[k].as_py())), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], ["part", "batch", "h", "n"])

    def gather(t: pa.Table) -> pa.Table:
        hs = [_read(x, "<u8") for x in t.column("h")]
        every = np.unique(np.concatenate(hs))
        at, n = [np.searchsorted(every, x) for x in hs], np.zeros(len(every), np.int64)
        for place, x in zip(at, t.column("n"), strict=True):
            n += np.bincount(place, _read(x, "<u4"), len(every)).astype(np.int64)
        rows, none = len(at), [None] * len(at)
        return pa.table({
            "part": pa.array([t.column("part")[0].as_py()] * (rows + 1)), "batch": pa.array([WORDS, *t.column("batch").to_pylist()]), "a": pa.array([_blob(every, "<u8"), *(_blob(np.diff(x, prepend=0), "<i4") for x in at)], pa.binary()),
            "n": pa.array([_blob(n, "<i8"), *none], pa.binary()), "tokens": pa.array([int(n.sum()), *none], pa.int64()), "known": pa.array([int((n > 0).sum()), *none], pa.int64()),
        })

    return encoded.select("batch", "h", "n").mapInArrow(lean(split), "part long, batch long, h binary, n binary").groupBy("part").applyInArrow(gather, VOCABULARY)


class Seeds:
    """The frequent words: hashes (the end token first), and where each is in its part (part -1: nowhere)."""

    def __init__(self, vocabulary: DataFrame, total: int, share: int):
        end = word_hash(END)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for k in range(rows.num_rows):
                    h, n = _read(rows.column("a")[k], "<u8"), _read(rows.column("n")[k], "<i8")
                    on = np.flatnonzero(((n * share >= total) & (n > 0)) | (h == np.uint64(end)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), rows.column("part")[k].as_py())), pa.array(on), pa.array(h[on].view(np.int64)), pa.array(n[on])], ["part", "place", "h", "n"])

        found = vocabulary.where(f"batch = {WORDS}").select("part", "a", "n").mapInArrow(lean(frequent), "part long, place long, h long, n long").collect()
        rows = sorted(((r.h & (1 << 64) - 1, r.part, r.place, r.n) for r in found), key=lambda r: (r[0] != end, -r[3], r[0]))
        rows = rows if rows and rows[0][0] == end else [(end, -1, -1, 0), *rows]
        self.h, self.part, self.place = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.order = np.argsort(self.h)

    def __len__(self) -> int:
        return len(self.h)

    def among(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the seeds, or -1."""
        at = np.minimum(np.searchsorted(self.h[self.order], h), len(self.h) - 1)
        return np.where(self.h[self.order][at] == h, self.order[at], -1)


def seed_bigrams(encoded: DataFrame, seeds: Seeds) -> DataFrame:
    """Rows (a, b, n): how often seed b follows seed a in training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                t, of = Tokens(rows.slice(k, 1)), seeds.among(_read(rows.column("h")[k], "<u8"))
                a, b, n = t.bigrams(len(of), int(np.flatnonzero(of == 0)[0]))
                on = (of[a] >= 0) & (of[b] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(of[a[on]].astype(np.int32)), pa.array(of[b[on]].astype(np.int32)), pa.array(n[on].astype(np.int64))], ["a", "b", "n"])

    return encoded.select("h", "codes", "starts", "held_out").mapInArrow(lean(count), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of words 0 (the end token, alone in class 0) to words - 1, by exchange from a start in order of frequency."""
    of = np.concatenate([[0], np.arange(words - 1) % (classes - 1) + 1]) if classes > 1 else np.zeros(words, int)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    out_at, in_at = np.searchsorted(a[by_a], np.arange(words + 1)), np.searchsorted(b[by_b], np.arange(words + 1))
    pairs = np.zeros((classes, classes))
    np.add.at(pairs, (of[a], of[b]), n)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, words):
            right, left = by_a[out_at[w] : out_at[w + 1]], by_b[in_at[w] : in_at[w + 1]]
            own = n[right][b[right] == w].sum()
            r = np.bincount(of[b[right]], n[right] * (b[right] != w), classes)
            l = np.bincount(of[a[left]], n[left] * (a[left] != w), classes)  # noqa: E741
            old = of[w]
            pairs[old] -= r
            pairs[:, old] -= l
            pairs[old, old] -= own
            rows, cols = pairs.sum(axis=1) + l, pairs.sum(axis=0) + r  # with the word's pairs, whatever its class
            base = _xlogx(pairs)
            gain = (_xlogx(pairs + r) - base).sum(axis=1) + (_xlogx(pairs + l[:, None]) - base).sum(axis=0)
            diag = np.diag(pairs)
            gain += _xlogx(diag + r + l + own) - _xlogx(diag + r) - _xlogx(diag + l) + _xlogx(diag)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + l.sum() + own) - _xlogx(cols)
            gain[0] = -np.inf
            new = int(gain.argmax()) if gain[int(gain.argmax())] > gain[old] + 1e-9 else old
            moved += new != old
            of[w] = new
            pairs[new] += r
            pairs[:, new] += l
            pairs[new, new] += own
        if not moved:
            break
    return of


def _fit_seeds(bigrams: DataFrame, words: int, classes: int) -> np.ndarray:
    """Runs the exchange in one task; its input is bounded by words^2."""

    def run(t: pa.Table) -> pa.Table:
        x = [t.column(c).to_numpy() for c in ("a", "b", "n")]
        order = np.lexsort((x[1], x[0]))
        of = exchange(*(c[order] for c in x), words, classes)
        return pa.table({"word": pa.array(np.arange(words, dtype=np.int32)), "class": pa.array(of.astype(np.int32))})

    rows = bigrams.groupBy().applyInArrow(run, "word int, class int").collect()
    out = np.arange(words) % classes
    for r in rows:
        out[r[0]] = r[1]
    return out


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of ``n``."""
    if not len(key):
        return key, n.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _answers(vocabulary: DataFrame, kinds: DataFrame, seeds: Seeds, with_counts: bool = False) -> DataFrame:
    """Rows (batch, part, a, s, n): of each batch's words of each part the classes, which seeds they are (or -1), and the counts if asked for."""

    def answer(t: pa.Table) -> pa.Table:
        batch, cells, part = t.column("batch").to_numpy(), t.column("a"), t.column("part")[0].as_py()
        of, n = np.empty(0, "<i2"), np.empty(0, "<i8")
        for k in np.flatnonzero(batch < 0):
            if batch[k] == KINDS:
                of = _read(cells[int(k)], "<i2")
            else:
                n = _read(t.column("n")[int(k)], "<i8")
        seed, here = np.full(len(of), -1, np.int16), np.flatnonzero(seeds.part == part)
        seed[seeds.place[here]] = here
        own = np.flatnonzero(batch >= 0)
        at = [_places(cells[int(k)]) for k in own]
        pack = lambda x, kind, on=True: pa.array([_blob(x[y], kind) if on else None for y in at], pa.binary())
        return pa.table({"batch": pa.array(batch[own]), "part": pa.array(np.full(len(own), part)), "a": pack(of, "<i2"), "s": pack(seed, "<i2", not with_counts), "n": pack(n, "<i8", with_counts)})

    asked = vocabulary if with_counts else vocabulary.where(f"batch <> {WORDS}")
    return asked.select("part", "batch", "a", "n").unionByName(kinds).groupBy("part").applyInArrow(answer, "batch long, part long, a binary, s binary, n binary")


def _counts(vocabulary: DataFrame) -> DataFrame:
    """Rows (batch, part, n): of each batch's words of each part the counts."""

    def answer(t: pa.Table) -> pa.Table:
        batch = t.column("batch").to_numpy()
        n = _read(t.column("n")[int(np.flatnonzero(batch == WORDS)[0])], "<i8")
        own = np.flatnonzero(batch >= 0)
        packed = [_blob(n[_places(t.column("a")[int(k)])], "<i8") for k in own]
        return pa.table({"batch": pa.array(batch[own]), "part": t.column("part").take(pa.array(own)), "n": pa.array(packed, pa.binary())})

    return vocabulary.select("part", "batch", "a", "n").groupBy("part").applyInArrow(answer, "batch long, part long, n binary")


def _joined(right: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a batch's answers, in the order of its words; its parts, and where their words start (one more entry)."""
    part = right.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    found = [_read(right.column(column)[int(k)], kind) for k in order]
    return np.concatenate([np.empty(0, kind), *found]), part[order], np.cumsum([0, *(len(x) for x in found)])


#: Rows of sums: of a part (its number), of seeds, or of class pairs; sizes say how many codes each word has.
EVIDENCE, SEEDS, PAIRS = "part long, batch long, sizes binary, codes binary, ns binary", -1, -2


def evidence(encoded: DataFrame, answers: DataFrame, classes: int, half: int | None = None) -> DataFrame:
    """For each batch and part, how often each training word (of one half by hash, if asked for) stands before a word of class ``code``, after one of class
    ``code - classes``, or before itself (2 * classes); words without a class are left out as neighbours. And how often classes follow each other."""

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "batch", "sizes", "codes", "ns"]
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 3], names)
        t, width = Tokens(left), 2 * classes + 1
        kind, part, cut = _joined(right, "a", "<i2")
        kind, seed = kind.astype(np.int64), _joined(right, "s", "<i2")[0].astype(np.int64)
        a, b, times = t.bigrams(len(kind), int(np.flatnonzero(seed == 0)[0]))
        ka, kb = kind[a], kind[b]
        on = (ka >= 0) & (kb >= 0)
        code, n = _sums(ka[on] * classes + kb[on], times[on])
        rows = [(PAIRS, b"", _blob(code, "<i4"), _blob(n, "<u4"))]
        same, r, l = a == b, kb >= 0, ka >= 0  # noqa: E741
        if half is not None:
            asked = in_half(_read(t.cell("h"), "<u8"), half)
            r, l = r & asked[a], l & asked[b]  # noqa: E741
        own = same if half is None else same & asked[a]
        r, l = r & ~same, l & ~same  # noqa: E741
        key, n = _sums(np.concatenate([a[r] * width + kb[r], b[l] * width + classes + ka[l], a[own] * width + 2 * classes]), np.concatenate([times[r], times[l], times[own]]))
        word, code = key // width, key % width
        hot = seed[word] >= 0
        rows.append((SEEDS, _blob(seed[word[hot]], "<i4"), _blob(code[hot], "<u2"), _blob(n[hot], "<u4")))
        word, code, n = word[~hot], code[~hot], n[~hot]
        at = np.searchsorted(word, cut)
        sizes = np.bincount(word, minlength=len(kind))
        for p, i, j, x, y in zip(part.tolist(), cut[:-1], cut[1:], at[:-1], at[1:], strict=True):
            if y > x:
                rows.append((p, _blob(sizes[i:j], "<u2"), _blob(code[x:y], "<u2"), _blob(n[x:y], "<u4")))
        p, *rest = zip(*rows, strict=True)
        give_back()
        return pa.table([pa.array(p, pa.int64()), pa.array([left.column("batch")[0].as_py()] * len(p), pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], names)

    tokens = encoded.select("batch", "codes", "starts", "held_out", *([] if half is None else ["h"]))
    return tokens.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(gather, EVIDENCE)


def _totals(found: DataFrame, part: int, width: int) -> pa.Table:
    """Sums (key, n) over all batches of the rows of ``part``: bounded by the number of keys."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                word, code = _read(rows.column("sizes")[k], "<i4").astype(np.int64), _read(rows.column("codes")[k], "<i4" if part == PAIRS else "<u2").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word * width + code if part == SEEDS else code), pa.array(_read(rows.column("ns")[k], "<u4").astype(np.int64))], ["key", "n"])

    return found.where(f"part = {part}").select("sizes", "codes", "ns").mapInArrow(unpack, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()


def class_pairs(found: DataFrame, classes: int) -> np.ndarray:
    """How often words of each class follow words of each class: at most classes^2 rows."""
    t, out = _totals(found, PAIRS, 0), np.zeros(classes * classes)
    out[t.column("key").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(classes, classes)


class Gains:
    """What the likelihood gains by class pairs that become more frequent: tables for small numbers, and the formula for others."""

    SMALL = 8

    def __init__(self, pairs: np.ndarray):
        self.pairs, self.both = pairs, np.concatenate([pairs.T, pairs])  # of a word before class j, then of one after class j
        log = _xlogx(self.both)
        self.up = [None, *(_xlogx(self.both + x) - log for x in range(1, self.SMALL + 1))]

    def rows(self, code: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
        """For each (code, n) the gain with each class."""
        for x in range(1, self.SMALL + 1):
            on = np.flatnonzero(n == x)
            out[on] = self.up[x][code[on]]
        on = np.flatnonzero(n > self.SMALL)
        base = self.both[code[on]]
        out[on] = _xlogx(base + n[on][:, None]) - _xlogx(base)


def choices(of: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, pairs: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
    """For each word (``of``: its class, or -1) the class that raises the likelihood most against the table of all class pairs, its own pairs
    taken out; -1 if nothing speaks for a class. Rows (word, code, n) as from ``evidence``, each once, sorted by word."""
    gains, c, out = Gains(pairs), len(pairs), np.empty(len(of), np.int64)
    # Words with at most two entries of one occurrence each are many, and few kinds: words of a kind (class and entries) move alike.
    first, last = np.searchsorted(word, np.arange(len(of))), np.searchsorted(word, np.arange(len(of)), "right")
    light = (last - first <= 2) & (np.bincount(word, n, len(of)) == last - first)
    entry = lambda at, on: np.where(on, code[np.minimum(at, max(len(code) - 1, 0))] + 1, 0) if len(code) else np.zeros(len(of), np.int64)
    kind = (entry(first, first < last) * (2 * c + 2) + entry(first + 1, first + 1 < last)) * (c + 1) + of + 1
    one, back = np.unique(kind[light], return_index=True, return_inverse=True)[1:]
    for chosen in (np.flatnonzero(light)[one], np.flatnonzero(~light)):
        step = max(1, at_once // c)
        for low in range(0, len(chosen), step):
            own = chosen[low : low + step]
            size = last[own] - first[own]
            rows = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out[own] = _choose(of[own], np.repeat(np.arange(len(own)), size), code[rows], n[rows].astype(np.float64), gains)
    out[light] = out[np.flatnonzero(light)[one]][back]
    return out


def _choose(of: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, gains: Gains) -> np.ndarray:
    c, count, pairs = len(gains.pairs), len(of), gains.pairs
    side = code < 2 * c
    w, k, x = word[side], code[side], n[side]
    own = np.bincount(word[~side], n[~side], count)
    total = lambda on: np.bincount(w[on], x[on], count)
    r, l = total(k < c), total(k >= c)  # noqa: E741
    gain = np.zeros((count, c))
    block = max(1, (1 << 19) // c)
    for low in range(0, len(w), block):
        wb = w[low : low + block]
        up = np.empty((len(wb), c))
        gains.rows(k[low : low + block], x[low : low + block], up)
        first = np.flatnonzero(np.concatenate([[True], wb[1:] != wb[:-1]]))
        gain[wb[first]] += np.add.reduceat(up, first, axis=0)
    # The table holds the word's own pairs, in the row and the column of its class: take them out. Entries of other classes differ for the class as
    # a candidate only; the entry of the class itself differs for all candidates.
    mine, member = of[w], of >= 0
    same = mine == k % c
    self_r, self_l = total(same & (k < c)), total(same & (k >= c))
    on = (mine >= 0) & ~same
    base = gains.both[k[on], mine[on]]
    less = np.maximum(base - x[on], 0)
    gain[member, of[member]] += np.bincount(w[on], _xlogx(less + x[on]) - _xlogx(less) - _xlogx(base + x[on]) + _xlogx(base), count)[member]
    for at, other in ((same & (k < c), k >= c), (same & (k >= c), k < c)):
        wa, xa = w[at], x[at][:, None]
        base, place = gains.both[k[at]], np.full(count, -1)
        place[wa] = np.arange(len(wa))
        theirs = other & (place[w] >= 0)
        less = base.copy()
        less[place[w[theirs]], k[theirs] % c] -= x[theirs]
        less[np.arange(len(wa)), of[wa]] -= x[at] + own[wa]
        less = np.maximum(less, 0)
        gain[wa] += _xlogx(less + xa) - _xlogx(less) - _xlogx(base + xa) + _xlogx(base)
    # Pairs within the candidate class are counted from both sides: where the word has both, or stands beside itself.
    whole = np.diag(pairs)
    taken = self_r + self_l + own
    r_key, l_key, r_x, l_x = w[k < c] * c + k[k < c], w[k >= c] * c + k[k >= c] - c, x[k < c], x[k >= c]
    alone = np.flatnonzero(own > 0)
    key = np.union1d(np.intersect1d(r_key, l_key, assume_unique=True), (alone[:, None] * c + np.arange(c)).ravel())

    def value(keys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, xs[at], 0.0) if len(keys) else np.zeros(len(key))

    i, j = key // c, key % c
    d = np.maximum(whole[j] - np.where(of[i] == j, taken[i], 0), 0)
    p, q = value(r_key, r_x), value(l_key, l_x)
    gain[i, j] += _xlogx(d + p + q + own[i]) - _xlogx(d + p) - _xlogx(d + q) + _xlogx(d)
    # Totals of the classes; words of equal frequency share their row.
    for sums, size in ((pairs.sum(axis=1), r + own), (pairs.sum(axis=0), l + own)):
        value, back = np.unique(size, return_inverse=True)
        gain -= (_xlogx(sums + value[:, None]) - _xlogx(sums))[back]
        now = sums[of[member]]
        gain[member, of[member]] += _xlogx(now + size[member]) - _xlogx(now) - _xlogx(now) + _xlogx(now - size[member])
    gain[:, 0] = -np.inf
    best = np.where(r + l + own > 0, gain.argmax(axis=1), -1)
    stay = member & ((best < 0) | (gain[np.arange(count), best] <= gain[np.arange(count), of] + 1e-9))
    return np.where(of == 0, 0, np.where(stay, of, best))


def in_half(h: np.ndarray, half: int) -> np.ndarray:
    """Which words are in a half of the vocabulary."""
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64) == half


def moved(found: DataFrame, vocabulary: DataFrame, kinds: DataFrame, seeds: Seeds, of_seeds: np.ndarray, pairs: np.ndarray, half: int | None = None) -> DataFrame:
    """Each part's classes (rows as ``kinds``) after every word (or ``half`` of them, 0 or 1) took its best one. A word that nothing speaks for yet takes one by its hash."""
    classes, width = len(pairs), 2 * len(pairs) + 1

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        part = right.column("part")[0].as_py()
        cell = {b: x for b, x in zip(right.column("batch").to_pylist(), right.column("a"), strict=True)}
        h, of = _read(cell[WORDS], "<u8"), _read(cell[KINDS], "<i2").astype(np.int64)
        keys, ns = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for k in range(left.num_rows):
            word = np.repeat(_places(cell[left.column("batch")[k].as_py()]), _read(left.column("sizes")[k], "<u2"))
            keys.append(word.astype(np.int64) * width + _read(left.column("codes")[k], "<u2"))
            ns.append(_read(left.column("ns")[k], "<u4"))
        key, n = _sums(np.concatenate(keys), np.concatenate(ns))
        new = choices(of, key // width, key % width, n, pairs)
        new = new if half is None else np.where(in_half(h, half) | (of < 0), new, of)
        new = np.where(new < 0, 1 + (h % np.uint64(max(classes - 1, 1))).astype(np.int64), new)
        new[seeds.place[seeds.part == part]] = of_seeds[seeds.part == part]
        give_back()
        return pa.table({"part": pa.array([part]), "batch": pa.array([KINDS]), "a": pa.array([_blob(new, "<i2")], pa.binary()), "n": pa.array([None], pa.binary())})

    rows = vocabulary.select("part", "batch", "a", "n").unionByName(kinds)
    return found.where("part >= 0").groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(choose, "part long, batch long, a binary, n binary")


def first_kinds(vocabulary: DataFrame, seeds: Seeds, of_seeds: np.ndarray) -> DataFrame:
    """A row per part with the classes of its words: those of seeds, and -1."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                part = rows.column("part")[k].as_py()
                of = np.full(len(_read(rows.column("a")[k], "<u8")), -1, "<i2")
                of[seeds.place[seeds.part == part]] = of_seeds[seeds.part == part]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([KINDS]), pa.array([_blob(of, "<i2")], pa.binary()), pa.array([None], pa.binary())], ["part", "batch", "a", "n"])

    return vocabulary.where(f"batch = {WORDS}").select("part", "a").mapInArrow(start, "part long, batch long, a binary, n binary")


def _information_scale(pairs: np.ndarray) -> float:
    """The size of what gains are measured by: the log likelihood of the class bigrams."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=1)).sum())


def _information(pairs: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=1)).sum() - _xlogx(pairs.sum(axis=0)).sum() + _xlogx(pairs.sum()))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it has ended; everything that is read twice here is a table in the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clustered(encoded: DataFrame, words: DataFrame, seeds: Seeds, of_seeds: np.ndarray, classes: int, least_gain: float) -> tuple[DataFrame, np.ndarray]:
    """Classes of all words (a row per part) when the exchange has settled, and how often classes follow each other."""
    width = 2 * classes + 1
    kinds, best, small = settle(first_kinds(words, seeds, of_seeds), "kinds"), None, 0  # small: rounds in a row without enough gain
    sums = lambda kinds, turn: settle(evidence(encoded, _answers(words, kinds, seeds), classes, turn), "evidence")
    for turn in chain([None], cycle([0, 1])):  # the half that moves; at first all take a class
        found = sums(kinds, turn)  # of the words that move next
        pairs = class_pairs(found, classes)
        now = _information(pairs)
        gain = math.inf if best is None else (now - best["information"]) / max(abs(_information_scale(pairs)), 1.0)
        small = 0 if gain > 0 and gain >= least_gain else small + 1
        if gain > 0:
            if best is not None:
                drop(best["kinds"])
            best = {"kinds": kinds, "seeds": of_seeds, "pairs": pairs, "information": now}
        else:
            drop(kinds, found)
        if small >= 2:
            if gain > 0:
                drop(found)
            return best["kinds"], best["pairs"]
        if gain <= 0:
            found = sums(best["kinds"], turn)
        t = _totals(found, SEEDS, width)
        key, n = _sums(t.column("key").to_numpy(), t.column("n").to_numpy())
        new = choices(best["seeds"], key // width, key % width, n, best["pairs"])
        new = np.where(new < 0, best["seeds"], new)
        of_seeds = new if turn is None else np.where(in_half(seeds.h, turn), new, best["seeds"])
        kinds = settle(moved(found, words, best["kinds"], seeds, of_seeds, best["pairs"], turn), "kinds")
        drop(found)
    raise AssertionError


def _counted(docs: DataFrame, batch_bytes: int, per_part: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The encoded batches, their vocabulary with counts, and how many training tokens and training words there are."""
    encoded = settle(encoded_batches(docs, batch_bytes), "encoded")
    parts = max(1, math.ceil((encoded.agg(F.sum("words")).first()[0] or 0) / per_part))
    words = settle(vocabulary(encoded, parts), "vocabulary")
    total, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    return encoded, words, total, distinct


def score_texts(docs: DataFrame, share: int = 4096, classes: int = 24, least_gain: float = 0.01, batch_bytes: int = 9 << 20, per_part: int = 1 << 18) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text, held_out). ``classes`` is the least
    number of classes: it is the cube root of the number of training words where that is more."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    with _shuffles_removed(spark):
        encoded, words, total, distinct = _counted(docs, batch_bytes, per_part)
        seeds = Seeds(words, total, share)
        n_classes = max(2, min(max(classes, math.ceil(distinct ** (1 / 3))), distinct))
        of_seeds = _fit_seeds(seed_bigrams(encoded, seeds), len(seeds), n_classes)
        kinds, seen = clustered(encoded, words, seeds, of_seeds, n_classes, least_gain)

    unseen = math.log10(0.5 / (total + 0.5 * (distinct + 1)))
    live = max(int((seen.sum(axis=0) > 0).sum()), 1)
    step = np.log10((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * live)) - np.log10(np.maximum(seen.sum(axis=0), 1)) + math.log10(max(1 - 10**unseen, 1e-12))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        t = Tokens(left)
        kind, count = _joined(right, "a", "<i2")[0].astype(np.int64), _joined(right, "n", "<i8")[0]
        kind[count == 0] = -1
        c, k, n = count[t.codes], kind[t.codes], len(t.starts) - 1
        owner = np.repeat(np.arange(n), np.diff(t.starts))
        sums = lambda x, of=owner: np.bincount(of, x, n)
        base = sums(np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))))
        value = sums(np.where(c > 0, np.log10(np.maximum(c, 1)), unseen))
        known = np.flatnonzero(k >= 0)  # the last known class is the context
        before = np.concatenate([[0], k[known[:-1]]])[: len(known)]
        before[np.concatenate([[True], owner[known[1:]] != owner[known[:-1]]])[: len(known)]] = 0
        value += sums(step[before, k[known]], owner[known])
        out = pa.table([t.cell("doc_id").values, pa.array(t.held_out), pa.array(np.diff(t.starts)), pa.array(sums(c > 0).astype(np.int64)), pa.array(base), pa.array(value)], names)
        give_back()
        return out

    tokens_ = encoded.select("batch", "codes", "starts", "doc_id", "held_out")
    out = tokens_.groupBy("batch").cogroup(_answers(words, kinds, seeds, with_counts=True).groupBy("batch")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def base_scores(docs: DataFrame, batch_bytes: int = 9 << 20, per_part: int = 1 << 18) -> DataFrame:
    """The rows of ``score_texts`` without ``score``: the base model needs the counts of words only, no classes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    with _shuffles_removed(spark):
        encoded, words, total, distinct = _counted(docs, batch_bytes, per_part)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        t = Tokens(left)
        c, n = _joined(right, "n", "<i8")[0][t.codes], len(t.starts) - 1
        sums = lambda x, of=np.repeat(np.arange(n), np.diff(t.starts)): np.bincount(of, x, n)
        base = sums(np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))))
        out = pa.table([t.cell("doc_id").values, pa.array(t.held_out), pa.array(np.diff(t.starts)), pa.array(sums(c > 0).astype(np.int64)), pa.array(base)], names)
        give_back()
        return out

    tokens_ = encoded.select("batch", "codes", "starts", "doc_id", "held_out")
    out = tokens_.groupBy("batch").cogroup(_counts(words).groupBy("batch")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 1)
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
