"""Column functions: vertex names, probabilities as metrics, repair of incomplete distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signal_of(vertex: Column) -> Column:
    """What stands before the last underscore of a vertex name."""
    return F.regexp_extract(vertex, r"^(.+)_([0-9]+)$", 1)


def index_of(vertex: Column) -> Column:
    return F.regexp_extract(vertex, r"^(.+)_([0-9]+)$", 2).try_cast("int")


def metric(p: Column) -> Column:
    """1 - p, held to [0, 1]."""
    return F.least(F.greatest(1 - p, F.lit(0.0)), F.lit(1.0))


def probability(w: Column) -> Column:
    return F.least(F.greatest(1 - w, F.lit(0.0)), F.lit(1.0))


def completed(p: Column, strategy: str) -> Column:
    """Fills the missing entries (NaN or null) of an array of probabilities.

    All missing, or nothing but zeros beside missing ones: uniform. ``tozero1``: missing ones are 0 and the others share what lacks to 1
    evenly; ``tozero2``: the others are scaled to 1; ``split``: missing ones share what lacks.
    """
    gone = lambda x: x.isNull() | F.isnan(x)
    known = F.filter(p, lambda x: ~gone(x))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    n, n_known = F.size(p), F.size(known)
    rest = 1 - total
    if strategy == "tozero1":
        filled = F.transform(p, lambda x: F.when(gone(x), 0.0).otherwise(x + rest / n_known))
    elif strategy == "tozero2":
        filled = F.transform(p, lambda x: F.when(gone(x), 0.0).otherwise(x / total))
    elif strategy == "split":
        filled = F.transform(p, lambda x: F.when(gone(x), rest / (n - n_known)).otherwise(x))
    else:
        raise ValueError(f"no such strategy: {strategy}")
    uniform = F.transform(p, lambda x: 1 / n)
    return F.when((n_known == 0) | ((n_known < n) & (total == 0)), uniform).when(n_known == n, p).otherwise(filled)


def token_codes(tokens: Column, alphabet: Column) -> Column:
    """Tokens as one string with a character for each token, by its place in ``alphabet``: input for ``levenshtein``."""
    return F.array_join(F.transform(tokens, lambda t: F.char(F.lit(64) + F.array_position(alphabet, t))), "")


def token_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two token arrays, as a fold over rows of the distance matrix."""
    start = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            cost = F.when(F.element_at(b, j) == x, 0).otherwise(1)
            best = F.least(F.element_at(prev, j + 1) + 1, F.element_at(acc, -1) + 1, F.element_at(prev, j) + cost)
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.element_at(prev, 1) + 1), cell)

    full = F.element_at(F.aggregate(a, start, row), -1)
    return F.when(F.size(a) == 0, F.size(b)).when(F.size(b) == 0, F.size(a)).otherwise(full)
