"""Suffix-array deduplication of repeated passages, with a difference-cover sort.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Suffixes are sorted where
they can matter only, and the sort is dealt out by content:

1. Every window of ``length`` bytes has an anchor, the smallest hash among its substrings of ``ANCHOR`` bytes. Equal windows have equal
   anchors, and neighbouring windows mostly share theirs: a run of windows with one anchor is a segment. Each document's
   anchors go, as 4 bytes and a count, to the partition of the anchor's hash, which answers with the anchors that several documents have.
2. Segments with such an anchor go to the bucket of the anchor, each distinct one once per batch of documents, with the
   smallest and the largest id that has it. So all windows that can be equal meet in one bucket, and a passage that a third
   of all documents share is a row per batch. Of an anchor with more than ``hot_segments`` segments (a line with a number that varies, say) every
   window goes on its own, to the bucket of its content: equal ones meet there too, and no bucket gets them all.
3. A bucket sorts its suffixes, an eighth of its anchors at a time, with the difference cover {1, 2} modulo 3: sampled triples are sorted and named, the names are
   sorted the same way (until names cover ``length`` bytes), and the other suffixes are merged in. Neighbours in the sorted
   order with equal prefixes of ``length`` bytes form a group, and its smallest id is the first document of that string.
4. Batches mark the windows whose string starts in a smaller document, and cut the union of marked windows.

Buckets hold about ``bucket_bytes`` of segments at any corpus size; their number follows the input. Texts are dealt into batches by a
hash, once: the three steps that read texts share one shuffle. Rows that repeat a doc_id are dealt by their own length and content.

Defined cases: null text is empty; documents shorter than ``length`` keep all bytes; rows that repeat a doc_id don't remove each
other's bytes (no id is smaller); a null id is larger than all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

LENGTH = 50
ANCHOR = 20
SLICE = 1 << 20
PARTS = 8  # of a bucket, a power of two
LAST = (1 << 63) - 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def _words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number (zeros beyond the end)."""
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    out = np.empty(len(b), _U)
    for k in range(8):
        n = len(b[k::8])
        out[k::8] = np.frombuffer(padded[k:].tobytes()[: n * 8], "<u8")
    return out


class Batch:
    """The texts of some documents in one byte string, cut into segments: runs of windows with the same anchor."""

    def __init__(self, t: pa.Table, length: int):
        t = t.combine_chunks()
        n = t.num_rows
        texts = [(x or "").encode() for x in t.column("text").to_pylist()]
        self.ids = np.array([LAST if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.anchor, self.start, self.count, self.doc = np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        # Texts of about SLICE bytes at a time: what is made for each byte takes many times the text's room.
        found = [self._segments(i, j, length) for i, j in self._slices()]
        if found:
            self.anchor, self.start, self.count, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))

    def _slices(self) -> list[tuple[int, int]]:
        """Ranges of documents with about SLICE bytes each; a longer one is a range of its own."""
        out, i, n = [], 0, len(self.ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + SLICE, "right")) - 1)
            out.append((i, j))
            i = j
        return out

    def _segments(self, i: int, j: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, places, numbers of windows and documents of the segments in the documents from ``i`` to before ``j``."""
        base, text, starts = self.starts[i], self.bytes[self.starts[i] : self.starts[j]], self.starts[i : j + 1] - self.starts[i]
        total, keep = len(text), max(len(text) - length + 1, 0)
        if not keep:
            return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        eight = _words_at(text)
        h, m = np.zeros(total - ANCHOR + 1, _U), total - ANCHOR + 1
        for k in [*range(0, ANCHOR - 7, 8), *([ANCHOR - 8] if ANCHOR % 8 else [])]:
            h ^= eight[k : k + m]
            h *= _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(32)
        h = _mix(h)
        del eight
        # Smallest hash among the length - ANCHOR + 1 substrings of each window: minima over spans that double.
        span, width = 1, length - ANCHOR + 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        low = np.minimum(h[:keep], h[width - span : width - span + keep])
        del h
        owner = np.repeat(np.arange(j - i), np.diff(starts))[:keep]
        valid = np.arange(keep) + length <= starts[owner + 1]
        cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])]))
        count = np.diff(np.append(cut, keep))
        good = valid[cut]
        start = cut[good]
        return low[start], start + base, count[good], owner[start] + i

    def weights(self, length: int) -> np.ndarray:
        """A number for each segment that tells different ones of an anchor apart by their ends: good enough for counts."""
        ends = np.zeros(len(self.start), _U)
        for k in range(8):
            ends = _mix(ends * _U(0x9E3779B97F4A7C15) + self.bytes[self.start + k] + (self.bytes[self.start + self.count + length - 2 - k].astype(_U) << _U(8)))
        return ends + self.count.astype(_U)

    def divided(self, hot: np.ndarray) -> np.ndarray:
        """Makes every window of the segments ``hot`` a segment of its own. Returns which segments are such windows."""
        at, n = np.flatnonzero(hot), self.count[hot]
        own = np.repeat(at, n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        join = lambda x: np.concatenate([x[~hot], x[own]])
        self.anchor, self.doc, start, count = join(self.anchor), join(self.doc), join(self.start), join(self.count)
        rest = len(start) - len(own)
        start[rest:] += step
        count[rest:] = 1
        self.start, self.count = start, count
        return np.arange(len(start)) >= rest

    def keys(self, length: int, at: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of the segments ``at``, from a prefix sum of scrambled bytes times powers. Its lowest bits come from the anchor
        alone (a number below ``PARTS``), so segments that can have equal windows share them."""
        slices, odd = self._slices(), 0x9E3779B97F4A7C15
        n = max((int(self.starts[j] - self.starts[i]) for i, j in slices), default=0)
        power, back = np.full(n + 1, odd, _U), np.full(n + 1, pow(odd, -1, 1 << 64), _U)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        out, doc = np.empty(len(at), _U), self.doc[at]
        order = np.argsort(doc, kind="stable")  # a hash doesn't depend on where the bytes are, so slices give the same
        cut = np.searchsorted(doc[order], [i for i, _ in slices] + [len(self.ids)])
        for (i, j), x, y in zip(slices, cut[:-1], cut[1:], strict=True):
            own = order[x:y]
            if not len(own):
                continue
            base, text = self.starts[i], self.bytes[self.starts[i] : self.starts[j]]
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(text.astype(_U) + _U(0x1234567)) * power[: len(text)], dtype=_U)])
            a = self.start[at[own]] - base
            b = a + self.count[at[own]] + length - 1
            out[own] = (sums[b] - sums[a]) * back[a]
        out = _mix(out + self.anchor[at] * _U(31) + self.count[at].astype(_U))
        return ((out & ~_U(PARTS - 1)) | (_mix(self.anchor[at]) >> _U(32)) % _U(PARTS)).view(np.int64)


def _split(anchor: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of an anchor, and 32 further bits of it."""
    return ((anchor >> _U(32)) % _U(partitions)).astype(np.int64), (anchor & _U(0xFFFFFFFF)).astype(np.uint32)


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of numbers from 0, equal ones alike."""
    order = np.argsort(x)
    y = x[order]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], y[1:] != y[:-1]]))
    return rank


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of a how many of b are smaller, and the other way round."""
    out = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    i, j = np.argsort(a), np.argsort(b)
    x, y = a[i], b[j]
    out[0][i], out[1][j] = np.searchsorted(y, x), np.searchsorted(x, y)
    return out


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """Ranks of triples of numbers below ``top``."""
    if top**3 < 1 << 25:  # short alphabets: by counting
        key = (a * top + b) * top + c
        seen = np.zeros(top**3, bool)
        seen[key] = True
        return (np.cumsum(seen) - 1)[key]
    if top**3 < 1 << 63:
        return _dense((a * top + b) * top + c)
    return _dense(_dense(a * top + b) * top + c)


def _ranks(s: np.ndarray, depth: int, need: np.ndarray | None = None) -> np.ndarray:
    """Numbers that order the suffixes of ``s`` (numbers of 1 or more) by at least ``depth`` first symbols, for those marked in ``need``."""
    n = len(s)
    p = np.concatenate([s, np.zeros(6, np.int64)])
    top = int(p.max()) + 1
    if depth <= 3:
        return _triples(p[:n], p[1 : n + 1], p[2 : n + 2], top)
    # Samples are the suffixes at 1 and 2 modulo 3; a last empty one stands in where n leaves none at 1.
    ones, twos, zeros = (n + 1) // 3 if n % 3 != 1 else (n + 2) // 3, n // 3 if n % 3 != 2 else (n - 2) // 3, (n + 2) // 3
    part = lambda k, m: p[k::3][:m]
    names = _triples(*(np.concatenate([part(1 + k, ones), part(2 + k, twos)]) for k in range(3)), top)
    want = np.zeros(3 * (zeros + 2), bool)
    want[:n] = True if need is None else need
    of = [want[k::3] for k in range(3)]
    # A suffix is ranked by the sample it is or that follows it.
    follow = of[0] | of[1]
    need_two = (follow | of[2])[:twos]
    need_one = (follow | np.concatenate([[False], of[2][:-1]]))[:ones]
    names = _ranks(names + 1, -(-depth // 3), np.concatenate([need_one, need_two])) + 1
    most = int(names.max()) + 2 if len(names) else 2
    one, two = np.zeros(zeros + 2, np.int64), np.zeros(zeros + 2, np.int64)
    one[:ones], two[:twos] = names[:ones], names[ones:]
    z, i, j = np.flatnonzero(of[0][:zeros]), np.flatnonzero(of[1][:ones]), np.flatnonzero(of[2][:twos])
    # The others are ordered by their first symbol and the rank of what follows, and merged with both samples.
    first, key_one = p[3 * z] * most + one[z], p[3 * i + 1] * most + two[i]
    pair_zero, pair_two = p[3 * z] * top + p[3 * z + 1], p[3 * j + 2] * top + p[3 * j + 3]
    if top * top * most >= 1 << 63:
        pairs = _dense(np.concatenate([pair_zero, pair_two]))
        pair_zero, pair_two = pairs[: len(z)], pairs[len(z) :]
    zero_one, one_zero = _between(first, key_one)
    zero_two, two_zero = _between(pair_zero * most + two[z], pair_two * most + one[j + 1])
    smaller = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([one[i], two[j]]), minlength=most))])
    out = np.zeros(n + 3, np.int64)
    own = np.sort(first)
    out[3 * z] = np.searchsorted(own, first) + zero_one + zero_two
    out[3 * i + 1] = smaller[one[i]] + one_zero
    out[3 * j + 2] = smaller[two[j]] + two_zero
    return out[:n]


def first_documents(segments: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment (``sizes`` bytes each, joined) the smallest id among segments with an equal window."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    need = np.zeros(len(segments), bool)
    need[at] = True
    rank = _ranks(segments.astype(np.int64) + 1, length, need)[at]
    order = np.argsort(rank, kind="stable")
    pos, eight = at[order], _words_at(segments)
    new = np.ones(len(pos), bool)
    same = np.ones(len(pos) - 1, bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        x = eight[pos + k]
        same &= x[1:] == x[:-1]
    new[1:] = ~same
    group = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[owner[order]], group)
    out = np.empty(len(pos), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(group, len(pos))))
    return out


def runs(keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one first document, by segment: (segment, id, windows, first window). Segments start at ``starts`` in ``data``. Those whose
    keys differ in the lowest bits share no window and are sorted apart: a sort takes about 80 times the room of its bytes."""
    part, found = keys & (PARTS - 1), []
    for p in range(PARTS):
        own = np.flatnonzero(part == p)
        if not len(own):
            continue
        n = size[own]
        place = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        first = first_documents(data[place], n, ids[own], length)
        del place
        windows = n - length + 1
        owner, begin = np.repeat(np.arange(len(own)), windows), np.cumsum(windows) - windows
        run = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (owner[1:] != owner[:-1])]))
        found.append((own[owner[run]], first[run], np.diff(np.append(run, len(first))), run - begin[owner[run]]))
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def repeated(docs: DataFrame, length: int = LENGTH, batch_bytes: int = 6 << 20, bucket_bytes: int = 3 << 20, hot_segments: int = 20_000, outputs: tuple[str, ...] = ("spans", "kept"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text), with the columns of ``docs`` named in ``carry``
    and these ``outputs``: ``spans``, removed runs as (start, bytes); ``kept``, what is left, as bytes; ``kept_text``, the same as text without
    characters that are cut in two."""
    if length < ANCHOR + 8:
        raise ValueError("strings are too short for anchors")
    docs = docs.select(F.col("doc_id").cast("long"), "text", *(F.col(c).alias(f"_{c}") for c in carry))
    carried = docs.drop("doc_id", "text").schema
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = max(1, math.ceil(total / batch_bytes))
    partitions = max(1, math.ceil(total / (32 << 20)))  # of anchors: about one in 16 bytes
    buckets = max(1, math.ceil(total / (2 * bucket_bytes)))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(batches)))
    groups = dealt.groupBy("batch")

    def anchors(t: pa.Table) -> pa.Table:
        b = Batch(t, length)
        n, value = len(b.anchor), np.sort(b.anchor)
        value = value[np.concatenate([[True], value[1:] != value[:-1]])] if n else value
        own = np.searchsorted(value, b.anchor)
        # Documents of the batch with each anchor (two stand for more), and its different segments.
        last = np.full(len(value), -1)
        last[own] = b.doc
        docs = 1 + np.isin(np.arange(len(value)), own[b.doc != last[own]])
        pair = np.unique(_mix(b.weights(length) + own.astype(_U) * _U(0xD6E8FEB86659FD93)), return_index=True)[1]
        several = np.bincount(own[pair], minlength=len(value)).astype(np.uint32)
        part, bits = _split(value, partitions)
        order = np.lexsort((bits, part))
        part, bits, docs, several = part[order], bits[order], docs[order].astype(np.uint8), several[order]
        cut = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())
        give_back()
        return pa.table({"part": pa.array(part[cut[:-1]], pa.int64()), "batch": pa.array([t.column("batch")[0].as_py() if t.num_rows else 0] * (len(cut) - 1), pa.int64()), "bits": pack(bits), "docs": pack(docs), "several": pack(several)})

    def shared(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        own = read("bits", np.uint32)
        values, which = np.unique(np.concatenate(own), return_inverse=True)
        docs, several = (np.bincount(which, np.concatenate(read(c, k)), len(values)) for c, k in (("docs", np.uint8), ("several", np.uint32)))
        on, hot, at = docs > 1, several > hot_segments, np.split(which, np.cumsum([len(x) for x in own])[:-1])
        return pa.table({"batch": t.column("batch"), "part": t.column("part"), "bits": pa.array([x[on[i]].tobytes() for x, i in zip(own, at, strict=True)], pa.binary()), "hot": pa.array([x[(on & hot)[i]].tobytes() for x, i in zip(own, at, strict=True)], pa.binary())})

    asked = groups.applyInArrow(anchors, "part long, batch long, bits binary, docs binary, several binary")
    answers = asked.groupBy("part").applyInArrow(shared, "batch long, part long, bits binary, hot binary")

    def marked(b: Batch, t: pa.Table, column: str) -> np.ndarray:
        """Which segments have an anchor that the rows (part, bits in ``column``) name."""
        part, bits = _split(b.anchor, partitions)
        named = [np.frombuffer(x, np.uint32).astype(np.int64) + (p << 32) for p, x in zip(t.column("part").to_pylist(), t.column(column).to_pylist(), strict=True) if x]
        return np.isin(bits.astype(np.int64) + (part << 32), np.concatenate(named)) if named else np.zeros(len(part), bool)

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left, length)
        on, hot = marked(b, right, "bits"), marked(b, right, "hot")
        b.anchor, b.start, b.count, b.doc = (x[on] for x in (b.anchor, b.start, b.count, b.doc))
        single = b.divided(hot[on])
        at = np.arange(len(b.start))
        none = pa.table({"bucket": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("keys", "least", "most", "sizes", "data")}})
        if not len(at):
            return none
        keys = b.keys(length, at)
        bucket = (_mix(np.where(single, keys.view(_U), b.anchor)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        at, keys, bucket = at[order], keys[order], bucket[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]))
        ids = b.ids[b.doc[at]]
        least, most = np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
        at, keys, bucket = at[new], keys[new], bucket[new]
        size = (b.count[at] + length - 1).astype(np.int32)
        cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        raw, starts = b.bytes.tobytes(), b.start[at].tolist()
        rows = [(int(bucket[i]), keys[i:j].tobytes(), least[i:j].tobytes(), most[i:j].tobytes(), size[i:j].tobytes(), b"".join([raw[starts[x] : starts[x] + int(size[x])] for x in range(i, j)])) for i, j in zip(cut, cut[1:], strict=False)]
        bucket_, *rest = zip(*rows, strict=True)
        give_back()
        return pa.table({"bucket": pa.array(bucket_, pa.int64()), "batch": pa.array([left.column("batch")[0].as_py()] * len(rows), pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("keys", "least", "most", "sizes", "data"), rest, strict=True)}})

    found = groups.cogroup(answers.groupBy("batch")).applyInArrow(segments, "bucket long, batch long, keys binary, least binary, most binary, sizes binary, data binary")

    def sort(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        keys, least, most, sizes, data = (join(c, k) for c, k in (("keys", np.int64), ("least", np.int64), ("most", np.int64), ("sizes", np.int32), ("data", np.uint8)))
        batch = np.repeat(t.column("batch").to_numpy(), [len(x) // 8 for x in t.column("keys").to_pylist()])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        ids = np.full(len(one), LAST)
        np.minimum.at(ids, which, least)
        size = sizes[one].astype(np.int64)
        run_owner, run_first, run_size, run_at = runs(keys[one], data, starts[one], size, ids, length)
        # Each batch gets the runs of its own segments that start in a document before its last.
        low, high = np.searchsorted(run_owner, which), np.searchsorted(run_owner, which, "right")
        entry = np.repeat(np.arange(len(which)), high - low)
        r = np.arange(len(entry)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[entry]
        useful = run_first[r] < most[entry]
        entry, r = entry[useful], r[useful]
        order = np.argsort(batch[entry], kind="stable")
        entry, r = entry[order], r[order]
        b = batch[entry]
        cut = [*np.flatnonzero(np.diff(b, prepend=-1)).tolist(), len(b)]
        pack = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())
        give_back()
        return pa.table({"batch": pa.array(b[cut[:-1]], pa.int64()), "keys": pack(keys[entry], np.int64), "at": pack(run_at[r], np.int32), "windows": pack(run_size[r], np.int32), "first": pack(run_first[r], np.int64)})

    firsts = found.groupBy("bucket").applyInArrow(sort, "batch long, keys binary, at binary, windows binary, first binary")
    none = F.lit(None).cast("binary")
    divided = answers.where("length(hot) > 0").select("batch", none.alias("keys"), none.alias("at"), none.alias("windows"), none.alias("first"), "part", "hot")
    firsts = firsts.withColumn("part", F.lit(None).cast("long")).withColumn("hot", none).unionByName(divided)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left, length)
        b.divided(marked(b, right.filter(pc.is_valid(right.column("hot"))), "hot"))
        right = right.filter(pc.is_valid(right.column("keys")))
        join = lambda c, kind: np.frombuffer(b"".join(right.column(c).to_pylist()), kind)
        keys, at, windows, first = (join(c, k) for c, k in (("keys", np.int64), ("at", np.int32), ("windows", np.int32), ("first", np.int64)))
        edge = np.zeros(len(b.bytes) + 1, np.int32)
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, at, windows, first = keys[order], at[order].astype(np.int64), windows[order].astype(np.int64), first[order]
            own = b.keys(length, np.arange(len(b.start)))
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            seg = np.repeat(np.arange(len(own)), high - low)
            r = np.arange(len(seg)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[seg]
            later = first[r] < b.ids[b.doc[seg]]
            seg, r = seg[later], r[later]
            begin = b.start[seg] + at[r]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + windows[r] + length - 1, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge
        n, full = len(b.ids), b.sizes > 0
        new, last = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
        new[b.starts[:-1][full]] = True
        last[b.starts[1:][full] - 1] = True
        new[1:] |= ~gone[:-1]
        last[:-1] |= ~gone[1:]
        a, z = np.flatnonzero(gone & new), np.flatnonzero(gone & last) + 1
        del gone, new, last
        owner = np.searchsorted(b.starts, a, "right") - 1  # of the spans
        bound, n_spans = np.bincount(owner, z - a, n), np.bincount(owner, minlength=n)
        raw, kept = b.bytes.tobytes(), []
        of = np.concatenate([[0], np.cumsum(n_spans)])
        for i in range(n):
            pos, parts = int(b.starts[i]), []
            for k in range(of[i], of[i + 1]):
                parts.append(raw[pos : a[k]])
                pos = int(z[k])
            parts.append(raw[pos : int(b.starts[i + 1])])
            kept.append(b"".join(parts))
        more = {}
        if "spans" in outputs:
            offsets = pa.array(of.astype(np.int32))
            more["spans"] = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a - b.starts[owner]), pa.array(z - a)], ["start", "bytes"]))
        if "kept" in outputs:
            more["kept"] = pa.array(kept, pa.binary())
        if "kept_text" in outputs:
            more["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        own = {"doc_id": left.column("doc_id"), "n_bytes": pa.array(b.sizes), "n_removed": pa.array(bound.astype(np.int64)), "n_spans": pa.array(n_spans.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        give_back()
        return pa.table(own | {f.name: left.column(f.name) for f in carried} | {c: more[c] for c in outputs})

    kinds = {"spans": "array<struct<start:bigint,bytes:bigint>>", "kept": "binary", "kept_text": "string"}
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), *(f"{c} {kinds[c]}" for c in outputs)])
    out = groups.cogroup(firsts.groupBy("batch")).applyInArrow(cut_out, schema)
    return out.withColumnsRenamed({f"_{c}": c for c in carry})


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"), outputs=()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
