"""Streaming invariants against the batch operator: any split into files, restarts, late events, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from specloom.operators import traces as tr
from specloom.streaming import invariants as si

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string"
BEGIN = dt.datetime(2024, 1, 1)


def _events(n, seed, hours=80):
    r = random.Random(seed)
    return [(i, r.choice([1, 1, 1, 2, 3, None]), BEGIN + dt.timedelta(minutes=r.randrange(hours * 60)), r.choice("abcd" if i % 7 else "xy")) for i in range(n)]


def _batch(spark, rows):
    placed = tr.positions(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, tr.pair_counts(placed).collect()))


def _put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, source, path, late=None, segment="2 hours"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    return si.run_to_end(si.segment_summaries(stream, segment=segment, late=late), path)


@pytest.mark.parametrize("parts", [1, 4])
def test_any_split_with_a_restart_equals_the_batch(spark, tmp_path, parts):
    rows, source, path = _events(250, parts), str(tmp_path / "in"), str(tmp_path / "out")
    random.Random(parts).shuffle(rows)
    for p in range(parts):
        _put(spark, rows[p::parts], source)
    assert sorted(map(tuple, si.pair_counts(_run(spark, source, path)).collect())) == _batch(spark, rows)
    more = [(1000 + i, *r[1:]) for i, r in enumerate(_events(60, 99))]
    _put(spark, more, source)
    assert sorted(map(tuple, si.pair_counts(_run(spark, source, path)).collect())) == _batch(spark, rows + more)


def test_ordered_files_need_their_disorder_only_and_the_state_goes(spark, tmp_path):
    rows, source, path = sorted(_events(240, 5), key=lambda r: (r[2], r[0])), str(tmp_path / "in"), str(tmp_path / "out")
    parts = [rows[i : i + 60] for i in range(0, 240, 60)]
    parts[1].append(parts[0].pop(-3))  # late, but within the watermark
    late = (5000, 1, BEGIN, "b")
    for p in [*parts[:3], [*parts[3], late]]:
        _put(spark, p, source)
    newest = _run(spark, source, path, late="12 hours")
    assert sorted(map(tuple, si.pair_counts(newest).collect())) == _batch(spark, rows)  # without the event that came days late
    # What is left of the state: segments that the watermark hasn't passed.
    state = spark.read.format("statestore").load(f"{path}/_state").select("key.*")
    ends = [r[0].end for r in state.select(state.columns[1]).collect()]
    limit = max(r[2] for r in rows) - dt.timedelta(hours=12)
    assert ends and min(ends) > limit


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    rows, source, path = _events(80, 8), str(tmp_path / "in"), str(tmp_path / "out")
    _put(spark, rows, source)
    _run(spark, source, path)
    for f in (tmp_path / "out" / "_state" / "commits").iterdir():  # as if the batch's end hadn't been noted
        f.unlink()
    assert sorted(map(tuple, si.pair_counts(_run(spark, source, path)).collect())) == _batch(spark, rows)


def test_null_empty_and_tied_events(spark, tmp_path):
    rows = [(1, 1, BEGIN, "a"), (1, 1, BEGIN, "a"), (2, 1, BEGIN, "b"), (3, 1, None, "a"), (4, 1, BEGIN, None), (None, None, BEGIN, "b"), (5, None, BEGIN, "c")]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    _put(spark, rows, source)
    got = {(r.a, r.b): (r.n_a, r.n_b, r.precedes, r.follows) for r in si.pair_counts(_run(spark, source, path)).collect()}
    assert got == {("a", "b"): (2, 2, 1, 2), ("a", "c"): (2, 1, 0, 0), ("b", "a"): (2, 2, 0, 0), ("b", "c"): (2, 1, 1, 1), ("c", "a"): (1, 2, 0, 0), ("c", "b"): (1, 2, 0, 0)}
    nothing = str(tmp_path / "nothing")
    spark.createDataFrame([], SCHEMA).write.parquet(nothing)
    assert si.pair_counts(_run(spark, nothing, str(tmp_path / "out2"))).count() == 0


def test_a_segment_by_hand(spark):
    row = spark.createDataFrame([(["a", "c", "b", "a"],)], "o array<string>").select(*si.summary(F.col("o"))).first()
    assert [tuple(t) for t in row[0]] == [("a", 2), ("b", 1), ("c", 1)]
    assert [tuple(p) for p in row[1]] == [("a", "b", 1, 1), ("a", "c", 1, 1), ("b", "a", 1, 1), ("b", "c", 0, 0), ("c", "a", 1, 1), ("c", "b", 1, 1)]
