"""Hand-worked cases of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from specloom.functions.columns import completed, index_of, token_distance
from specloom.operators import boolfn, edit, graphs, logic, network, paths, patterns, traces
from specloom.plans import mining
from specloom.sources import tables


def fx_a(spark):
    """Four vertices: A_0 -> A_1, B_0 -> B_1, A_0 -> B_1."""
    rows = []

    def add(v, pa, pv, vals, ps):
        rows.extend(("m", v, pa, pv, o, i, p) for i, (o, p) in enumerate(zip(vals, ps, strict=True)))

    a, b = ["a0", "a1"], ["b0", "b1"]
    add("A_0", [], [], a, [0.9, 0.1])
    add("A_1", ["A_0"], ["a0"], a, [0.2, 0.8])
    add("A_1", ["A_0"], ["a1"], a, [0.7, 0.3])
    add("B_0", [], [], b, [0.6, 0.4])
    for pv, ps in ((["b0", "a0"], [0.1, 0.9]), (["b0", "a1"], [0.5, 0.5]), (["b1", "a0"], [0.95, 0.05]), (["b1", "a1"], [0.3, 0.7])):
        add("B_1", ["B_0", "A_0"], pv, b, ps)
    return spark.createDataFrame(rows, "model_id string, vertex string, parents array<string>, parent_vals array<string>, outcome string, outcome_idx int, p double")


def vertices(cpt):
    v = cpt.groupBy("model_id", "vertex", "parents").agg(F.array_sort(F.collect_set("outcome")).alias("vals"))
    return v.withColumn("signal", F.split_part("vertex", F.lit("_"), F.lit(1))).withColumn("idx", index_of(F.col("vertex")))


def test_marginals_weights_paths(spark):
    cpt = fx_a(spark)
    v = vertices(cpt)
    m = {(r.vertex, r.outcome): r.p for r in network.marginals(cpt, 2).collect()}
    assert m["A_1", "a0"] == pytest.approx(0.25) and m["B_1", "b0"] == pytest.approx(0.438)
    w = network.edge_weights(cpt, network.marginals(cpt, 2))
    got = {(r.src, r.src_val, r.dst, r.dst_val): r.w for r in w.collect()}
    assert got["B_0", "b0", "B_1", "b0"] == pytest.approx(0.86) and got["B_0", "b1", "B_1", "b0"] == pytest.approx(0.115) and got["A_0", "a0", "B_1", "b1"] == pytest.approx(0.44)
    assert network.naming_check(v).first().consistent
    assert {(r.src, r.dst) for r in network.cross_edges(network.edges(v)).collect()} == {("A_0", "B_1")}
    assert network.path_count(v, 2).first().n == 12
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    found = paths.below(w, network.boundary_edges(v), states, 0.8, 1).orderBy("metric").collect()
    assert [r.tokens for r in found] == [["B:b1", "B:b0"], ["B:b0", "B:b1"], ["A:a0", "A:a1"]]  # the last lies on the threshold
    removed = network.without_edges(cpt, network.cross_edges(network.edges(v)))
    assert {(r.parent_vals[0], r.outcome): round(r.p, 6) for r in removed.where("vertex = 'B_1'").collect()} == {("b0", "b0"): 0.3, ("b0", "b1"): 0.7, ("b1", "b0"): 0.625, ("b1", "b1"): 0.375}


def test_trace_invariants(spark):
    log = [(1, i, e) for i, e in enumerate("abac")] + [(2, i, e) for i, e in enumerate("bc")]
    t = spark.createDataFrame(log, "user_id int, pos int, event_type string")
    got = {(r.kind, r.a, r.b): r.ratio for r in traces.invariants(traces.pair_counts(t), 0.8).collect()}
    assert got == {("precedes", "b", "c"): 1.0, ("follows", "a", "c"): 1.0, ("follows", "b", "c"): 1.0, ("not_followed", "c", "a"): None, ("not_followed", "c", "b"): None}


def test_positions_break_ties_by_id(spark):
    rows = [(3, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:00:00", 1), (2, "2024-01-02 00:00:00", 1), (4, "2023-12-31 00:00:00", 1)]
    t = spark.createDataFrame(rows, "event_id int, ts string, user_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.pos for r in traces.positions(t).collect()} == {4: 0, 1: 1, 3: 2, 2: 3}


@pytest.mark.parametrize(("strategy", "want"), [("tozero1", [0.6, 0, 0.4]), ("tozero2", [0.625, 0, 0.375]), ("split", [0.5, 0.2, 0.3])])
def test_incomplete_distributions(spark, strategy, want):
    t = spark.createDataFrame([([0.5, math.nan, 0.3],), ([math.nan, None, math.nan],)], "p array<double>").select(completed(F.col("p"), strategy).alias("p")).collect()
    assert t[0].p == pytest.approx(want) and t[1].p == pytest.approx([1 / 3] * 3)


def test_token_distance(spark):
    pairs = [("kitten", "sitting", 3), ("", "ab", 2), ("ab", "", 2), ("", "", 0), ("abc", "abc", 0)]
    t = spark.createDataFrame([(list(a), list(b), d) for a, b, d in pairs], "a array<string>, b array<string>, d int")
    assert t.where(token_distance(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_confusion_is_symmetric(spark):
    t = spark.createDataFrame([("m", 0, ["x", "yy"]), ("m", 1, ["x", "z"]), ("n", 0, ["q"])], "model_id string, path_id int, tokens array<string>")
    d = {(r.model_id, r.a, r.b): r.d for r in edit.confusion(t).collect()}
    assert d == {("m", 0, 0): 0, ("m", 1, 1): 0, ("m", 0, 1): 1, ("m", 1, 0): 1, ("n", 0, 0): 0}


def kripke(spark, trans, labels):
    t = spark.createDataFrame(trans, "src int, dst int")
    states = t.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    return logic.Kripke(states, t, spark.createDataFrame(labels, "state int, ap string"))


def test_logic_textbook(spark):
    k = kripke(spark, [(1, 2), (2, 3), (4, 4), (3, 3)], [(1, "p"), (2, "p"), (3, "q"), (4, "q")])
    sat = lambda f: {r.state for r in k.sat(f).collect()}
    assert sat(("EU", "p", "q")) == {1, 2, 3, 4}
    assert sat(("EX", "p")) == {1} and sat(("EG", "q")) == {3, 4} and sat(("AG", ("EF", "q"))) == {1, 2, 3, 4}
    assert logic.text(("AU", "p", ("not", "q"))) == "A(p U not(q))" and logic.height(("EX", ("or", "p", "q"))) == 2


def test_partial_relation_is_an_error(spark):
    with pytest.raises(ValueError, match="total"):
        kripke(spark, [(1, 2)], [(1, "p")]).checked()


def test_network_structure_is_whole(spark):
    """Every edge with all pairs of values, those of probability zero too; a cut at 4 % of a state's steps would lose most of 60 values."""
    vals = [f"x{i:02d}" for i in range(60)]
    v = spark.createDataFrame([("m", "A_0", "A", 0, [], vals), ("m", "A_1", "A", 1, ["A_0"], vals), ("n", "A_0", "A", 0, [], ["y"]), ("n", "A_1", "A", 1, ["A_0"], ["y"])], "model_id string, vertex string, signal string, idx int, parents array<string>, vals array<string>")
    k = logic.of_network(v, network.edges(v).union(network.boundary_edges(v))).checked()
    got = {(r.src, r.dst) for r in k.transitions.collect()}
    want = {(f"m/A_0:{i}", f"m/A_1:{j}") for i in range(60) for j in range(60)} | {("m/start:0", f"m/A_0:{i}") for i in range(60)} | {(f"m/A_1:{i}", "m/terminal:0") for i in range(60)} | {("m/terminal:0", "m/terminal:0")}
    assert got == want | {("n/start:0", "n/A_0:0"), ("n/A_0:0", "n/A_1:0"), ("n/A_1:0", "n/terminal:0"), ("n/terminal:0", "n/terminal:0")} and k.transitions.count() == len(got)
    assert {r.state for r in k.sat(("EX", "A:x07")).collect()} == {"m/start:0", *(f"m/A_0:{i}" for i in range(60))}


def test_components_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "src int, dst int")
    assert {r.node: r.component for r in graphs.strong_components(e).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.node for r in graphs.reachable(e, spark.createDataFrame([(2,)], "node int")).collect()} == {1, 2, 3}


def test_boolean_functions(spark):
    f = spark.createDataFrame([(a, b, a) for a in (False, True) for b in (False, True)], "a boolean, b boolean, f boolean")
    assert [r.variable for r in boolfn.essential(f).collect()] == ["a"]
    assert boolfn.equivalent(f, boolfn.negated(boolfn.negated(f))).first().equivalent


def test_model_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"V": ["A_0", "A_1"], "E": [["A_0", "A_1"]], "Vdata": {"A_0": {"vals": ["x", "y"], "parents": null, "type": "discrete"}}}')
    v, e = tables.skeleton(tables.read_model_files(spark, str(tmp_path)))
    assert v.count() == 2 and e.select("src", "dst").collect() == [("A_0", "A_1")]
    tables.write_specs(spark.createDataFrame([(0.88449, "G(a)")], "probability double, ltl string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "0.8845, G(a)"


def test_pattern_merge(spark):
    merge = lambda *seqs: patterns.merge_runs(spark.createDataFrame([("k", i, list(s), [False] * len(s)) for i, s in enumerate(seqs)], "key string, ord int, tokens array<string>, xable array<boolean>"), 10).withColumn("text", patterns.as_text(F.col("symbols"))).withColumn("ctl", patterns.as_ctl(F.col("symbols"))).orderBy(F.desc("step"))
    row = patterns.metrics(merge("ABCDEF", "AbCDeF")).first()
    assert row.text.replace("<F>", "") == "(A)(B|b)(C)(D)(E|e)(F)" and (row.length, row.letters, row.strings, row.compared) == (6, 4, 4, True)
    row = patterns.metrics(merge("ACE", "CE")).first()
    assert row.length == 2 and row.ctl == "E(A U (C and EX(E)))"
    assert patterns.metrics(merge("A")).first().length == 0


def test_merging_goes_on_until_the_rules_end_it(spark):
    """Against a plain loop over all other paths by distance; the nearest four are not enough for path 0."""
    seqs = ["ABCDEFGHIJ"] * 5 + ["aBCDEFGHIJ", "ABcDEFGHIJ", "ABCDeFGHIJ", "ABCDEFgHIJ", "ABCDEFGHiJ", "ABCDEFGHIj", "XYZ"]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row = row, [i]
            for j, b in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        return row[-1]

    want = {}
    for i, s in enumerate(seqs):
        pattern, mean, met, compared, by_metric = None, 0.0, [], True, 0
        for step, b in enumerate(sorted(range(len(seqs)), key=lambda k: (distance(s, seqs[k]), k))):
            flags = [k % 2 == 1 for k in range(len(seqs[b]))]
            pattern = patterns.letters(seqs[b], flags) if pattern is None else patterns.merged(pattern, list(seqs[b]), flags)
            met.append(b / 100)
            want[i, step] = (pattern, 1 - sum(met) / len(met))
            fixed = [k for k, x in enumerate(pattern) if x["kind"] != "option"]
            part = pattern[fixed[0] : fixed[-1] + 1]
            n, half = math.prod(len(x["tokens"]) + (x["kind"] == "option") for x in part), len(part) // 2
            ratio = sum(x["kind"] == "letter" for x in part) / len(part)
            compared = compared and ratio >= 0.5 and n <= 2.5**half
            by_metric = by_metric or (-1 if ratio < 0.5 or n > 2**half else int(ratio <= 0.8 and n >= 2 ** (len(part) // 5 + 1)))
            if not compared and by_metric:
                break
    rows = [("m", i, list(s), [k % 2 == 1 for k in range(len(s))], i / 100) for i, s in enumerate(seqs)]
    got = mining.patterns_of_paths(spark.createDataFrame(rows, "model_id string, path_id int, tokens array<string>, xable array<boolean>, metric double")).collect()
    assert {(r.path_id, r.step) for r in got} == set(want) and len(got) == len(want) and max(r.step for r in got if r.path_id == 0) >= 4
    for r in got:
        pattern, p = want[r.path_id, r.step]
        assert r.probability == pytest.approx(p) and (r.compared, r.by_metric) == patterns.acceptance(pattern)
    assert all("<X>" in r.pattern for r in got if r.path_id == 0 and r.step == 0)


def test_edge_flags_reach_tokens(spark):
    v = spark.createDataFrame([("m", f"A_{i}", [f"A_{i - 1}", f"B_{i - 1}"] if i else []) for i in range(200)], "model_id string, vertex string, parents array<string>")
    flags = patterns.edge_flags(v)
    per = flags.groupBy("dst").agg(F.sum(F.col("xable").cast("int")).alias("n")).collect()
    assert len(per) == 199 and {r.n for r in per} == {0, 1} and 0.55 < sum(r.n for r in per) / 199 < 0.85
    of = {(r.src, r.dst): r.xable for r in flags.collect()}
    path = spark.createDataFrame([("m", 0, [(f"A_{i}", "x") for i in range(30)])], "model_id string, path_id int, nodes array<struct<v:string,val:string>>")
    assert mining.flagged(path, flags).first().xable == [False] + [of[f"A_{i - 1}", f"A_{i}"] for i in range(1, 30)]
