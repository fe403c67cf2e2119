"""Joins over time: the last row of another table before each row, and pairs of rows that are close in time.

``as_of`` needs no pairs: both sides are one table, and a window remembers the last right row. Windows hold one key and one span of time; what a span
ends with is carried into the later spans of its key by a second window over spans. So a key with most of the rows is many groups, and what
is carried is a row for each span. ``close_pairs`` is an equi-join on key and span: a left row looks into the one or two spans that its range touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(f"`{c}`").cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str], order: list[str] = (), inclusive: bool = False, span: int = DAY, name: str = "found") -> DataFrame:
    """Adds ``name`` to the rows of ``left``: a struct of ``take`` and ``time`` from the right row with equal ``keys`` that is the last one before the left row's time
    (``inclusive``: at or before it), the largest by ``order`` among those of the same time; null where there is none.

    Both tables have ``keys`` and a timestamp ``time``. Null keys meet nothing, left rows without a time find nothing, right ones count nothing. ``span`` is the
    length of a group in seconds and changes no result.
    """
    keys_l, keys_r = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    found = F.struct(*[F.col(f"`{c}`") for c in (*take, time)])
    ties = F.struct(F.lit(0).alias("z"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    some_key = F.lit(True)
    for k in keys:
        some_key = some_key & F.col(f"`{k}`").isNotNull()
    r = right.where(some_key & F.col(f"`{time}`").isNotNull()).select(*keys_r, _micros(time).alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), ties.alias("_o"), found.alias("_r"))
    bare = r.limit(0).select("_o", "_r").schema
    nothing = [F.lit(None).cast(bare[c].dataType).alias(c) for c in ("_o", "_r")]
    both = left.select(*keys_l, _micros(time).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), *nothing, own.alias("_l"))
    both = both.unionByName(r.withColumn("_l", F.lit(None).cast(both.schema["_l"].dataType))).withColumn("_span", F.floor(F.col("_t") / (span * 1_000_000)))
    names = [f"_k{i}" for i in range(len(keys))]
    within = Window.partitionBy(*names, "_span").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_r", ignorenulls=True).over(within)).where("_l IS NOT NULL")
    last = F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_o")))
    spans = both.where("_span IS NOT NULL").groupBy(*names, "_span").agg(last.alias("_last"))
    before = Window.partitionBy(*names).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*names, "_span", F.last("_last", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL")
    out = near.join(carried, [*names, "_span"], "left")
    hit = F.when(some_key_of(names) & F.col("_t").isNotNull(), F.coalesce("_near", "_before"))
    return out.select(hit.alias("_hit"), "_l").select(*[F.col(f"_l.`{c}`") for c in left.columns if c != name], F.col("_hit").alias(name))


def some_key_of(names: list[str]) -> Column:
    out = F.lit(True)
    for k in names:
        out = out & F.col(k).isNotNull()
    return out


def close_pairs(left: DataFrame, right: DataFrame, keys: list[str], time: str, before: float, after: float) -> DataFrame:
    """Rows (l, r) of structs: pairs with equal ``keys`` whose right row is at most ``before`` seconds earlier and ``after`` seconds later than the left one, borders
    included. Null keys and times meet nothing. A right row lies in one span, so every pair is found once; the result is as large as the pairs are many."""
    low, high = round(before * 1_000_000), round(after * 1_000_000)
    width = max(low + high, 1)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df, n: df.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, names, strict=True)], _micros(time).alias(f"_{n}t"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(n))
    place = lambda t: F.floor(t / width).cast("long")
    ls = keyed(left, "l").where("_lt IS NOT NULL").withColumn("_span", F.explode(F.sequence(place(F.col("_lt") - low), place(F.col("_lt") + high))))
    rs = keyed(right, "r").withColumn("_span", place(F.col("_rt")))
    return ls.join(rs, [*names, "_span"]).where((F.col("_rt") >= F.col("_lt") - low) & (F.col("_rt") <= F.col("_lt") + high)).select("l", "r")
