"""Decision diagrams against plain functions over all assignments."""

import random

import pytest
from pyspark.sql import functions as F

from specloom.operators import diagrams as dd

N = 7


def plain(true, k=0, prefix=0, n=N):
    """The reduced diagram of a set of assignments, as nested tuples."""
    if k == n:
        return prefix in true
    low, high = plain(true, k + 1, prefix * 2, n), plain(true, k + 1, prefix * 2 + 1, n)
    return low if low == high else (k, low, high)


def as_tuple(nodes, root):
    if root in (dd.FALSE, dd.TRUE):
        return root == dd.TRUE
    x = nodes[root]
    return (x.variable, as_tuple(nodes, x.low), as_tuple(nodes, x.high))


def parts(t):
    return set() if isinstance(t, bool) else {t} | parts(t[1]) | parts(t[2])


@pytest.fixture(scope="module")
def functions():
    rng = random.Random(5)
    every = range(2**N)
    return {
        "some": {a for a in every if rng.random() < 0.4}, "few": set(rng.sample(every, 9)), "all": set(every), "high": {a for a in every if a >= 64}, "low_bit": {a for a in every if a & 1},
        "parity": {a for a in every if a.bit_count() % 2}, "one": {3}, "again": {3},
    }


def test_diagrams_are_reduced_counted_and_combined(spark, functions):
    rows = [(k, a) for k, v in functions.items() for a in v] * 2 + [(None, 1), ("few", None)]
    nodes, roots = dd.built(spark.createDataFrame(rows, "fn string, assignment long").withColumn("id", F.lit("clash")), N)
    by_id, root = {r.id: r for r in nodes.collect()}, {r.fn: r.id for r in roots.collect()}
    assert {k: as_tuple(by_id, v) for k, v in root.items()} == {k: plain(v) for k, v in functions.items()}
    assert len(by_id) == nodes.count() == len(set().union(*(parts(plain(v)) for v in functions.values())))
    assert {r.fn: int(r.n_true) for r in dd.counted(nodes, roots, N).collect()} == {k: len(v) for k, v in functions.items()}
    assert {r.fn: r.same_as for r in dd.equal_pairs(roots).collect()} == {k: "again" if k == "one" else k for k in functions}
    assert {(r.fn, r.id) for r in dd.reached(nodes, roots, N).where("fn = 'parity'").collect()} == {("parity", r) for r, x in by_id.items() if as_tuple(by_id, r) in parts(plain(functions["parity"]))}

    names = sorted(functions)
    ops = {"and": set.__and__, "or": set.__or__, "xor": set.__xor__}
    want = {f"{a} {op} {b}": plain(f(functions[a], functions[b])) for a in names for b in names for op, f in ops.items()}
    asked = [(k, k.split()[1], root[k.split()[0]], root[k.split()[2]]) for k in want]
    more, out = dd.applied(nodes, spark.createDataFrame(asked, "fn string, op string, a string, b string"), N)
    by_id = {r.id: r for r in more.collect()}
    assert {r.fn: as_tuple(by_id, r.id) for r in out.collect()} == want and all(x.low != x.high for x in by_id.values())


def test_diagrams_of_many_variables_and_of_nothing(spark):
    """60 variables, where a truth table has 2 ** 60 rows; no rows; no variables."""
    rows = [("f", 1 << i) for i in range(60)]
    nodes, roots = dd.built(spark.createDataFrame(rows, "fn string, assignment long"), 60)
    assert nodes.count() == 2 * 60 - 1 and int(dd.counted(nodes, roots, 60).first().n_true) == 60
    empty = spark.createDataFrame([], "fn string, assignment long")
    nodes, roots = dd.built(empty, 4)
    assert not nodes.count() and not roots.count() and not dd.counted(nodes, roots, 4).count() and not dd.reached(nodes, roots, 4).count()
    assert dd.built(spark.createDataFrame([("f", 0)], "fn string, assignment long"), 0)[1].first().id == dd.TRUE
    with pytest.raises(ValueError):
        dd.built(empty, 63)
    with pytest.raises(ValueError):
        dd.assignment([F.lit(True)] * 63)
    bits = spark.createDataFrame([(True, False, True), (None, True, True)], "a boolean, b boolean, c boolean")
    assert [r.x for r in bits.select(dd.assignment([F.col("a"), F.col("b"), F.col("c")]).alias("x")).collect()] == [5, None]
