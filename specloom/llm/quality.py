"""Quality classifier: a generalised additive model with pairwise interactions over features of the whole text.

Each round of boosting visits the features in turn and adds a shallow tree of one feature, fitted to the current
residuals, to that feature's lookup table; afterwards the strongest pairs get tables of their own, from trees that split
both features. A score is a sum of table entries: bins are found by binary search and added up for a batch at once.

Features come from the text alone. They are computed for all rows in tasks; the model is fitted on about ``sample``
labelled rows (all, if there are fewer), those below a threshold on a hash of the id, and is a few thousand numbers. Rows above it never leave their task.

Defined cases: null and empty texts have features like any other (all zero) and get a score; several labels of a document are
as many training rows; without labels of both kinds every score is the share of label 1 (0.5 without labels); repeated rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, pieces, remainder, settle, split_words, table

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "symbol", "beyond_ascii", "line_ends",
    "distinct_words", "top_word", "same_as_before", "short_words", "words_with_symbol", "capital_words", "top_line", "distinct_bigrams", "words_per_line",
]
_CLASS = np.full(256, 5, np.uint8)  # upper 0, lower 1, digit 2, symbol 3, white space 4, beyond ASCII 5
_CLASS[:128] = 3
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 0, 1, 2, 4


def _groups(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: how many distinct keys it has, and how often its most frequent one occurs."""
    span = int(key.max()) + 1 if len(key) else 1
    pair, times = np.unique(owner * span + key, return_counts=True)
    own = pair // span
    most = np.zeros(n)
    np.maximum.at(most, own, times)
    return np.bincount(own, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(texts)
    if texts.offset:
        texts = texts.take(pa.array(np.arange(n)))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = b"".join(x.as_buffer() for x in texts) if n else b""
    kind, ends = _CLASS[np.frombuffer(whole, np.uint8)], np.cumsum(size)
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[np.concatenate([[0], ends])]) for k in range(6)], axis=1)
    newline = np.diff(np.concatenate([[0], np.cumsum(np.frombuffer(whole, np.uint8) == 10)])[np.concatenate([[0], ends])])
    flat, starts = split_words(texts, lower=False)
    lower = pc.ascii_lower(flat)
    codes = lower.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.diff(starts)
    owner = np.repeat(np.arange(n), n_words)
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    mean = lambda x: np.bincount(owner, x, n) / np.maximum(n_words, 1)
    distinct, most = _groups(owner, codes, n)
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])]) if len(codes) else np.zeros(0, bool)
    follow = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    bigrams, _ = _groups(owner[follow], (codes[follow] * 1_000_003 + codes[follow + 1]) % (1 << 31), n)
    symbols = pc.match_substring_regex(flat, r"[!-,/:-@\[-`{-~]").to_numpy(zero_copy_only=False)
    capital = (pc.match_substring_regex(flat, r"^[A-Z]{2,}").to_numpy(zero_copy_only=False)) & (length > 2)
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines, top_line = np.bincount(line_owner, minlength=n), _groups(line_owner, line_codes, n)[1]
    per = counts / np.maximum(size, 1)[:, None]
    words = np.maximum(n_words, 1)
    out = np.stack([
        np.log1p(size), np.log1p(n_words), mean(length), per[:, 0], per[:, 1], per[:, 2], per[:, 3], per[:, 5], newline / np.maximum(size, 1),
        distinct / words, most / words, mean(same), mean(length <= 3), mean(symbols), mean(capital), top_line / np.maximum(n_lines, 1) * (n_lines > 1), bigrams / words, n_words / np.maximum(n_lines, 1),
    ], axis=1)
    out[size == 0] = 0
    return out


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree of at most ``leaves`` leaves over ordered bins: greedy best splits by squared gradient over weight."""
    parts, g, h = [(0, len(gain))], np.concatenate([[0], np.cumsum(gain)]), np.concatenate([[0], np.cumsum(weight)])
    while len(parts) < leaves:
        found = None
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            value = (g[m] - g[a]) ** 2 / (h[m] - h[a] + 1) + (g[b] - g[m]) ** 2 / (h[b] - h[m] + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
            k = int(value.argmax())
            if value[k] > 1e-9 and (found is None or value[k] > found[0]):
                found = (value[k], i, int(m[k]))
        if found is None:
            break
        a, b = parts[found[1]]
        parts[found[1] : found[1] + 1] = [(a, found[2]), (found[2], b)]
    out = np.zeros(len(gain))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 60, rate: float = 0.1, bins: int = 64, pairs: int = 6, coarse: int = 8) -> dict:
    """Cuts and lookup tables. ``x``: a row of features per labelled document; ``y``: 0 or 1."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = {"bias": np.log(base / (1 - base)), "cuts": [], "tables": [], "pairs": []}
    if len(np.unique(y)) < 2:
        return model
    for f in x.T:
        model["cuts"].append(np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])))
    binned = [np.searchsorted(c, f, "right") for c, f in zip(model["cuts"], x.T, strict=True)]
    model["tables"] = [np.zeros(len(c) + 1) for c in model["cuts"]]
    score = np.full(len(y), model["bias"])
    chance = lambda: 1 / (1 + np.exp(-score))
    for _ in range(rounds):
        for b, t in zip(binned, model["tables"], strict=True):
            p = chance()
            step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), 3)
            t += step
            score += step[b]
    rough = [np.minimum(b * coarse // len(t), coarse - 1) for b, t in zip(binned, model["tables"], strict=True)]
    p, gains = chance(), []
    for i in range(len(binned)):
        for j in range(i):
            cell = rough[i] * coarse + rough[j]
            g, h = np.bincount(cell, y - p, coarse * coarse), np.bincount(cell, p * (1 - p), coarse * coarse)
            gains.append((float((g * g / (h + 1)).sum()), i, j))
    model["pairs"] = [(i, j, np.zeros((coarse, coarse))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model["pairs"]:
            p, cell = chance(), rough[i] * coarse + rough[j]
            g, h = np.bincount(cell, y - p, coarse * coarse).reshape(coarse, coarse), np.bincount(cell, p * (1 - p), coarse * coarse).reshape(coarse, coarse)
            best, step = -1.0, np.zeros((coarse, coarse))
            for cut in range(1, coarse):  # a split of one feature, and on each side one of the other
                sides = [(rows, _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 2)) for rows in (slice(0, cut), slice(cut, coarse))]
                value = sum(float((g[rows].sum(axis=0) * leaf).sum()) for rows, leaf in sides)
                if value > best:
                    best = value
                    for rows, leaf in sides:
                        step[rows] = rate * leaf
            t += step
            score += step.ravel()[cell]
    return model | {"coarse": coarse}


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Chances of label 1: sums of table entries."""
    score = np.full(len(x), model["bias"])
    if model["tables"]:
        binned = [np.searchsorted(c, f, "right") for c, f in zip(model["cuts"], x.T, strict=True)]
        for b, t in zip(binned, model["tables"], strict=True):
            score += t[b]
        rough = [np.minimum(b * model["coarse"] // len(t), model["coarse"] - 1) for b, t in zip(binned, model["tables"], strict=True)]
        for i, j, t in model["pairs"]:
            score += t[rough[i], rough[j]]
    return 1 / (1 + np.exp(-score))


def text_features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, features) of documents (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(compute), "doc_id long, features array<double>")


def learn(labelled: DataFrame, sample: int = 20_000) -> dict:
    """Fits on about ``sample`` rows (doc_id, features, label), taken by a hash of the id."""
    rows = labelled.where("label IS NOT NULL").select("doc_id", "features", "label")
    share = min(1.0, sample / max(rows.count(), 1))
    key = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    rows = sorted(rows.where(key < math.ceil((1 << 30) * share)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.label, r.features))
    return fit(np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.label) for r in rows]))


def score(rows: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, score) of rows (doc_id, features)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(predict(x, model))], ["doc_id", "score"])

    return rows.select("doc_id", "features").mapInArrow(add_up, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(text_features(table(spark, sf_dir, "documents")), "features")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("d"), F.col("quality").alias("label"))
    model = learn(rows.join(labels.where(remainder("d", 3) != 1), F.col("doc_id") == F.col("d")).drop("d"))
    return score(rows, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
