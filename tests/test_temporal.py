"""Joins over time and learned Gaussians against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.operators import gaussian as ga
from specloom.operators import temporal as tm

DAY = dt.datetime(2024, 3, 1)


def events(n, seed, users=3):
    """User 0 has most rows; times repeat; some keys and times are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = None if rng.random() < 0.05 else 0 if rng.random() < 0.7 else rng.randrange(users)
        out.append((i, user, None if rng.random() < 0.05 else DAY + dt.timedelta(minutes=rng.randrange(0, 6000, 7)), rng.randrange(100)))
    return out


SCHEMA = "id int, user int, ts timestamp_ntz, value int"


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("span", [600, tm.DAY, 10**9])
def test_as_of_equals_a_loop(spark, inclusive, span):
    left, right = events(150, 1), events(200, 2)
    found = tm.as_of(spark.createDataFrame(left, SCHEMA).withColumn("found", F.lit("clash")), spark.createDataFrame(right, SCHEMA), ["user"], "ts", ["id", "value"], ["id"], inclusive, span)
    assert found.columns == ["id", "user", "ts", "value", "found"]
    want = {}
    for i, user, ts, _ in left:
        before = [r for r in right if None not in (user, ts, r[2]) and r[1] == user and (r[2] < ts or inclusive and r[2] == ts)]
        want[i] = max(before, key=lambda r: (r[2], r[0]))[0] if before else None
    assert {r.id: r.found and r.found.id for r in found.collect()} == want
    empty = spark.createDataFrame([], SCHEMA)
    assert {r.found for r in tm.as_of(spark.createDataFrame(left, SCHEMA), empty, ["user"], "ts", ["id"]).collect()} == {None} and not tm.as_of(empty, empty, ["user"], "ts", ["id"]).count()


def test_as_of_splits_a_hot_key(spark):
    """One user with all rows is as many groups as days."""
    rows = spark.range(5000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("user"), (F.lit(DAY) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("value"))
    found = tm.as_of(rows, rows.where("id % 2500 = 3"), ["user"], "ts", ["id"])
    assert {(r.id, r.found.id if r.found else None) for r in found.collect()} == {(i, None if i <= 3 else 3 if i <= 2503 else 2503) for i in range(5000)}
    plan = found._jdf.queryExecution().toString()
    assert "_span" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(("before", "after"), [(3600, 1800), (0, 0), (0, 86400)])
def test_close_pairs_equal_a_loop(spark, before, after):
    left, right = events(60, 3), events(80, 4)
    got = tm.close_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["user"], "ts", before, after)
    want = sorted((a[0], b[0]) for a in left for b in right if None not in (a[1], a[2], b[2]) and a[1] == b[1] and -before <= (b[2] - a[2]).total_seconds() <= after)
    assert sorted((r.l.id, r.r.id) for r in got.collect()) == want and want


def test_gaussian_fit_and_draws(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g, x1, x2 = rng.integers(0, 3, n), rng.normal(1e6, 1, n), rng.normal(0, 2, n)
    y = np.array([1.0, -2.0, 5.0])[g] + np.array([0.5, 3.0, 0.0])[g] * (x1 - 1e6) - 1.5 * x2 + rng.normal(0, 0.3, n)
    rows = [(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x1, x2, y, strict=True)] + [(0, None, 1.0, 1.0), (1, 1.0, math.nan, 1.0), (7, 2.0, 3.0, 4.0), (8, None, None, 1.0)]
    t = spark.createDataFrame(rows, "g int, x1 double, x2 double, y double").withColumn("same", F.lit(2.0))
    fitted = ga.fit(t, ["g"], "y", ["x1", "x2", "same"])
    got = {r.g: r for r in fitted.collect()}
    assert set(got) == {0, 1, 2, 7} and got[0].n == int((g == 0).sum())
    for k in range(3):
        own = g == k
        a = np.stack([np.ones(own.sum()), x1[own] - 1e6, x2[own]], axis=1)
        want, rest, *_ = np.linalg.lstsq(a, y[own], rcond=None)
        assert got[k].mean_scal[:2] == pytest.approx(list(want[1:]), abs=1e-6) and got[k].mean_scal[2] == pytest.approx(0, abs=1e-9) and got[k].variance == pytest.approx(rest[0] / own.sum(), rel=1e-4)
        assert got[k].mean_base + got[k].mean_scal[0] * 1e6 == pytest.approx(want[0], abs=1e-3)
    assert got[7].mean_scal == [0, 0, 0] and got[7].mean_base == 4 and got[7].variance == 0
    ids = t.withColumn("id", F.monotonically_increasing_id())
    drawn = ga.draws(ids, fitted, ["g"], ["x1", "x2", "same"], [F.col("id").cast("string")])
    shuffled = ga.draws(ids, fitted, ["g"], ["x1", "x2", "same"], [F.col("id").cast("string")], small=0)
    assert sorted(map(str, drawn.select("id", F.round("draw", 6)).collect())) == sorted(map(str, shuffled.select("id", F.round("draw", 6)).collect()))
    spread = drawn.where("g = 1 AND x1 > 100").select(F.stddev_pop(F.col("draw") - F.col("y"))).first()[0]
    assert spread == pytest.approx(0.3 * math.sqrt(2), rel=0.1) and drawn.where("g = 8 AND draw IS NULL").count() == 1
    assert {(r.mean_base, tuple(r.mean_scal), r.variance) for r in ga.cleared(fitted).collect()} == {(0.0, (0.0, 0.0, 0.0), 0.1)}
    flat = ga.fit(t, ["g"], "y", [])
    assert {r.g: r.mean_base for r in flat.where("g = 7").collect()} == {7: 4.0} and not ga.fit(t.limit(0), ["g"], "y", ["x1"]).count()
