"""Networks of interleaved logs against plain loops, and specifications between origins."""

import random
from collections import Counter, defaultdict

from specloom import catalog_interleaved as ci
from specloom.operators import interleaved as il

VALUES = "model_id string, log long, sample long, signal string, idx int, value string"


def test_the_usual_one_before_and_ties(spark):
    rows = [("m", "b", "a")] * 2 + [("m", "c", "a")] * 2 + [("m", "a", "a")] * 9 + [("m", "c", "b"), ("n", "a", "b")]
    got = il.usual_before(spark.createDataFrame(rows, "model_id string, cur string, nxt string"))
    assert sorted(map(tuple, got.collect())) == [("m", "a", "b"), ("m", "b", "c"), ("n", "b", "a")]


def test_vertices_follow_the_signals_lengths(spark):
    values = spark.createDataFrame([("m", 0, 0, "a", 2, "x"), ("m", 0, 0, "b", 0, "x"), ("n", 0, 0, "a", 0, "x")], VALUES)
    before = spark.createDataFrame([("m", "a", "b"), ("m", "b", "a")], "model_id string, signal string, other string")
    got = sorted(map(tuple, il.structure(values, before).collect()))
    assert got == [("m", "a_0", []), ("m", "a_1", ["a_0", "b_0"]), ("m", "a_2", ["a_1"]), ("m", "b_0", []), ("n", "a_0", [])]


def test_observations_equal_a_plain_loop(spark):
    r = random.Random(3)
    lengths = {"a": 3, "b": 4, "c": 2}
    rows = [("m", log, s, sig, i, r.choice(["x", "y", "y", None])) for log in range(5) for s in range(6) for sig, n in lengths.items() for i in range(n) if r.random() < 0.9]
    rows += [(*x[:5], "z") for x in rows[::25]]  # a second value of a place: the largest counts
    other = {"a": "c", "b": "a"}
    before = spark.createDataFrame([("m", s, o) for s, o in other.items()], "model_id string, signal string, other string")
    values = spark.createDataFrame(rows, VALUES)
    samples = defaultdict(dict)
    for _, log, s, sig, i, v in rows:
        if v is not None:
            samples[log, s][sig, i] = max(v, samples[log, s].get((sig, i), v))
    want = Counter()
    for at in samples.values():
        for (sig, i), v in at.items():
            pa = [(sig, i - 1)] + ([(other[sig], i - 1)] if sig in other and i - 1 < lengths[other[sig]] else []) if i else []
            if all(p in at for p in pa):
                want[f"{sig}_{i}", tuple(f"{s}_{k}" for s, k in pa), tuple(at[p] for p in pa), v] += 1
    got = Counter((x.vertex, tuple(x.parents), tuple(x.parent_vals), x.outcome) for x in il.observations(values, il.structure(values, before)).collect())
    assert got == want


def test_no_rows(spark):
    values = spark.createDataFrame([], VALUES)
    before = spark.createDataFrame([], "model_id string, signal string, other string")
    assert il.observations(values, il.structure(values, before)).count() == 0


def test_specifications_between_origins(spark):
    rows = [("2", "m", "G(F0V:lo -> F F0V:hi)", True), ("2", "m", "G(F0V:lo -> F F1V:lo)", False), ("2", "m", None, True), ("3", "m", "F F2V:lo", False)]
    got = ci.false_specs(spark.createDataFrame(rows, "model_id string, miner string, ltl string, loose boolean"))
    assert sorted(map(tuple, got.collect())) == [("2", "m", 2, 1, 1), ("3", "m", 1, 0, 0)]


def test_pairs_by_time_equal_pairs_by_place(spark):
    """Null times and users, equal times, and rows that repeat (ts, event_id) with another type; no positions are made."""
    from pyspark.sql import functions as F

    from specloom.operators import traces as tr

    rows = [(u if u < 4 else None, i, None if (i * u) % 11 == 3 else f"2024-01-0{1 + (i * 7 + u) % 5} 0{(i * 3) % 4}:00:00", "abcd"[(i * i + u) % 4]) for u in range(5) for i in range(40)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    by_time = tr.pair_counts(events, place=tr.by_time())
    got, want = (sorted(map(tuple, t.collect())) for t in (by_time, tr.pair_counts(tr.positions(events))))
    assert got == want and len(got) == 12 and any(r[4] for r in got)
    assert "Window" not in by_time._jdf.queryExecution().toString()
    twice = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "user_id long, event_id long, event_type string").withColumn("ts", F.lit(None).cast("timestamp"))
    assert sorted(map(tuple, tr.pair_counts(twice, place=tr.by_time()).collect())) == [("a", "b", 1, 1, 1, 1), ("b", "a", 1, 1, 0, 0)]
