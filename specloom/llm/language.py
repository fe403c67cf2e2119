"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

Model: counts of hashed character n-grams (1 to 3 letters, with word borders) for each language, and which scripts a language
is written in; 2^15 counts a language, so its size is bounded by the number of languages. Learned from all training rows by
partial sums in each task.

Prediction: a word's score for a language is the log probability of its n-grams; languages that are not written in the word's
script are ruled out. Over the words of a text, the best path through languages pays ``penalty`` for every switch; runs of one
label are spans. The prediction is the language whose spans have most letters, the score the share of all letters that these spans
have in scripts of a learned language. Paths are computed for many texts at once, a step per word position.

Tasks take texts in slices of ``SLICE`` bytes, whatever the size of Arrow's batches, and keep sums only; n-grams exist for a block
of a slice's distinct words at a time.

Defined cases: null texts and texts without a letter (combining marks alone are none) are ``und`` with score 0; if no language is
written in a word's script the word says nothing and counts nothing in the score, so a text wholly in unlearned scripts has score 0; ties go
to the first language by code point; without training rows all is ``und``; a null id counts as the empty text for the split; other columns are kept by ``identify`` unless their names clash with its own, which
replace them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, lean, pieces, remainder, split_words, table

BUCKETS = 1 << 15
SLICE = 2 << 20
BLOCK = 1 << 16
#: Where scripts start and end among the code points.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
]
NAMES = ["other", *dict.fromkeys(x[0] for x in SCRIPTS)]


def _scripts(points: np.ndarray) -> np.ndarray:
    """The script of each code point, as an index into NAMES."""
    out = np.zeros(len(points), np.int64)
    for name, low, high in SCRIPTS:
        out[(points >= low) & (points <= high)] = NAMES.index(name)
    return out


class Words:
    """The distinct words of some texts: letters only, lower case, with their n-gram buckets and script."""

    def __init__(self, texts: pa.Array):
        flat, self.starts = split_words(texts, lower=False)
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pM]+", "")
        letters = pc.if_else(pc.match_substring_regex(letters, r"\pL"), letters, "")  # marks need a letter to stand on
        self.letters = pc.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int32)
        points = np.frombuffer((" " + "  ".join(letters.to_pylist()) + " ").encode("utf-32-le"), np.uint32)
        self.n = len(self.letters)
        self.points, self.ends = points, np.cumsum(self.letters + 2, dtype=np.int64)
        lead = self.ends - self.letters - 1  # the first letter of each word
        self.script = np.where(self.letters > 0, _scripts(points[np.minimum(lead, len(points) - 1)]), 0) if self.n else np.zeros(0, np.int64)

    def grams(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Blocks of words of about ``BLOCK`` letters, a longer word alone: which words, and for each n-gram its word's place in the block and its bucket."""
        i, start = 0, 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.ends, start + BLOCK, "right")))
            end, letters = int(self.ends[j - 1]), self.letters[i:j]
            points = self.points[start:end]
            owner = np.repeat(np.arange(j - i, dtype=np.int32), letters + 2)
            h, owners, buckets = np.zeros(len(points), np.uint64), [], []
            for k in range(3):
                m = len(points) - k
                h = h[:m]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += points[k:]
                h += np.uint64(k + 1)
                inside = owner[:m] == owner[k:]
                inside &= letters[owner[:m]] > 0
                owners.append(owner[:m][inside])
                buckets.append(((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.uint16))
            yield slice(i, j), np.concatenate(owners), np.concatenate(buckets)
            i, start = j, end


def count_grams(batch: pa.RecordBatch, grams: dict[str, np.ndarray]) -> None:
    """Adds a batch's n-grams and letters by script to the counts of its languages."""
    for part in pieces(batch, "text", SLICE):
        w = Words(part.column("text"))
        langs = part.column("lang").to_pylist()
        of_word = np.repeat(np.arange(len(langs), dtype=np.int32), np.diff(w.starts))
        times = {}
        for lang in dict.fromkeys(langs):
            own = np.array([x == lang for x in langs])
            times[lang] = np.bincount(w.codes[own[of_word]], minlength=w.n)
            c = grams.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
            if w.n:
                c[BUCKETS:] += np.bincount(w.script, times[lang] * w.letters, len(NAMES))
        for words, owner, bucket in w.grams():
            for lang, n in times.items():
                grams[lang][:BUCKETS] += np.bincount(bucket, n[words][owner], BUCKETS)


def learn(docs: DataFrame) -> dict:
    """Learns from rows (text, lang); null langs are left out. Returns languages, log probabilities and allowed scripts."""
    kinds = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            count_grams(batch, grams)
        for lang, c in grams.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    bound_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(lean(count), kinds).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, total = rows.column("lang").to_pylist(), {}
    for lang, bucket, n in zip(names, rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), strict=True):
        total.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))[bucket] = n
    langs = sorted(total)
    if not langs:
        return {"langs": []}
    c = np.stack([total[x] for x in langs])
    grams, letters = c[:, :BUCKETS] + 0.5, c[:, BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "logp": np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), "allowed": share >= 0.01}


def _word_scores(w: Words, model: dict) -> np.ndarray:
    s = np.empty((w.n, len(model["logp"])))
    for words, owner, bucket in w.grams():
        for k, row in enumerate(model["logp"]):
            s[words, k] = np.bincount(owner, row[bucket], words.stop - words.start)
    s /= 3
    allowed = model["allowed"].T[w.script]
    allowed[~allowed.any(axis=1)] = True
    s -= s.max(axis=1, keepdims=True)
    s[~model["allowed"].any(axis=0)[w.script]] = 0
    return np.where(allowed, s, s.min(axis=1, keepdims=True) - 1000.0)


def _paths(scores: np.ndarray, codes: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. Texts are sorted by length; each step handles all texts that still have a word."""
    lengths, n_langs = np.diff(starts), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[:-1][order], lengths[order]
    labels = np.zeros(len(codes), np.int16)
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    best, came = np.zeros((len(order), n_langs)), []
    ids = np.arange(n_langs, dtype=np.int16)
    for t, a in enumerate(active):
        now = best[:a]
        top = now.argmax(axis=1)
        jump = now[np.arange(a), top] - penalty
        stay = now >= jump[:, None]
        came.append(np.where(stay, ids, top[:, None].astype(np.int16)))
        best[:a] = np.where(stay, now, jump[:, None]) + scores[codes[first[:a] + t]]
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        labels[first[:a] + t] = state[:a]
        state[:a] = came[t][np.arange(a), state[:a]]
    return labels


def label_texts(texts: pa.Array, model: dict, penalty: float) -> tuple[list, np.ndarray, list]:
    """For each text: the language or None, its share of the letters, and spans (lang, first word, words)."""
    n, langs = len(texts), model["langs"]
    w = Words(texts)
    if not w.n or not langs:
        return [None] * n, np.zeros(n), [[] for _ in range(n)]
    has = w.letters[w.codes] > 0
    kept = np.concatenate([[0], np.cumsum(has)])
    codes, starts, place = w.codes[has], kept[w.starts], np.flatnonzero(has)
    labels = _paths(_word_scores(w, model), codes, starts, penalty)
    owner = np.repeat(np.arange(n), np.diff(starts))
    place = place - w.starts[owner]
    letters = np.bincount(owner * len(langs) + labels, w.letters[codes], n * len(langs)).reshape(n, len(langs))
    top, total = letters.argmax(axis=1), letters.sum(axis=1)
    readable = model["allowed"].any(axis=0)[w.script[codes]]
    score = np.bincount(owner, w.letters[codes] * (readable & (labels == top[owner])), n) / np.maximum(total, 1)
    cut = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    spans: list[list] = [[] for _ in range(n)]
    for a, b in itertools.pairwise([*cut.tolist(), len(labels)]):
        spans[owner[a]].append({"lang": langs[labels[a]], "first": int(place[a]), "words": int(place[b - 1] - place[a] + 1)})
    return [langs[x] if y else None for x, y in zip(top.tolist(), total.tolist(), strict=True)], score, spans


SPANS = "array<struct<lang:string,first:int,words:int>>"


def identify(docs: DataFrame, model: dict, penalty: float = 8.0, with_spans: bool = True) -> DataFrame:
    """Adds lang_pred, score and, if asked for, spans to every row of ``docs`` (with a ``text``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2^15 numbers a language
    schema = docs.limit(0).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *([F.lit(None).cast(SPANS).alias("spans")] if with_spans else [])).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                lang, score, spans = label_texts(part.column("text"), shared.value, penalty)
                new = [pa.array([x or "und" for x in lang], pa.string()), pa.array(score)]
                if with_spans:
                    new.append(pa.array(spans, to_arrow_schema(schema).field("spans").type))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "lang_pred", "score", *(["spans"] if with_spans else [])])

    return docs.mapInArrow(lean(label), schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = learn(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model, with_spans=False).select("doc_id", "held_out", "lang_pred", "score")
