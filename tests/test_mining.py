"""Miners and linear formulas against worked cases and plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom import catalog_mining
from specloom.operators import logic as lg
from specloom.operators import matching, network, patterns, paths
from specloom.operators.patterns import GROUP, LETTER, OPTION, letters, linear_formula, merged
from specloom.plans import mining
from specloom.sources.tables import checkpointed

#: A worked network: two signals of two places, B_1 with parents B_0 and A_0.
ROWS = {
    ("A_0",): [[], [((), (0.9, 0.1))]],
    ("A_1",): [["A_0"], [(("a0",), (0.2, 0.8)), (("a1",), (0.7, 0.3))]],
    ("B_0",): [[], [((), (0.6, 0.4))]],
    ("B_1",): [["B_0", "A_0"], [(("b0", "a0"), (0.1, 0.9)), (("b0", "a1"), (0.5, 0.5)), (("b1", "a0"), (0.95, 0.05)), (("b1", "a1"), (0.3, 0.7))]],
}


def worked(spark):
    cpt, vertices = [], []
    for (v,), (parents, rows) in ROWS.items():
        vals = ["a0", "a1"] if v[0] == "A" else ["b0", "b1"]
        vertices.append(("m", v, v[0], int(v[2:]), parents, vals))
        cpt += [("m", v, parents, list(given), vals[i], i, p) for given, ps in rows for i, p in enumerate(ps)]
    t = spark.createDataFrame(cpt, "model_id string, vertex string, parents array<string>, parent_vals array<string>, outcome string, outcome_idx int, p double")
    v = spark.createDataFrame(vertices, "model_id string, vertex string, signal string, idx int, parents array<string>, vals array<string>")
    return checkpointed(t), checkpointed(v)


def accepted(spark, theta, xable):
    t, v = worked(spark)
    w = network.edge_weights(t, network.marginals(t, 2))
    states = v.select("model_id", F.col("vertex").alias("v"), F.explode("vals").alias("val"))
    found = paths.numbered(paths.below(w, network.boundary_edges(v), states, theta, 1)).withColumn("xable", F.transform("tokens", lambda x, i: (i > 0) & F.lit(xable)))
    return t, v, checkpointed(found)


@pytest.mark.parametrize(("xable", "first"), [(False, "G((B:b1 --> X(F(B:b0))))"), (True, "G((B:b1 --> X(B:b0)))")])
def test_comparison_based_on_the_worked_network(spark, xable, first):
    t, v, found = accepted(spark, 0.8, xable)
    tries = checkpointed(mining.attempts(found).withColumn("theta", F.lit(0.8)))
    specs = sorted(mining.comparison_based(tries, mining.judge(t, v, 2)).collect(), key=lambda r: -r.probability)
    assert [round(r.probability, 9) for r in specs] == [0.885, 0.86] and specs[0].ltl == first and all(r.n_merged == 1 and not r.loose for r in specs)


def brute_matches(symbols, states, net, theta=None):
    """Mean weights of all matches, by walking each one."""
    fixed = [i for i, s in enumerate(symbols) if s["kind"] != OPTION]
    part, out = symbols[fixed[0] : fixed[-1] + 1], []

    def walk(i, v, x, last, w):
        if i == len(part):
            out.append(np.mean(w))
            return
        before = len(out)
        for child in net.children[v]:
            for value in [y for (u, y), token in net.states.items() if u == child and token in part[i]["tokens"]]:
                walk(i + 1, child, value, i, [*w, net.weight[v, x, child, value]])
        if part[i]["kind"] == OPTION:
            walk(i + 1, v, x, last, w)
        if len(out) == before and part[last]["kind"] == OPTION and net.after[v]:
            walk(i, net.after[v], x, last, [*w, net.weight[v, x, net.after[v], x]])

    for v, x in states:
        walk(1, v, x, 0, [])
    return out


def _network(seed, length=4):
    rng = np.random.default_rng(seed)
    nodes, weights = [], []
    for s in "EV":
        for k in range(length):
            children = ([f"{s}_{k + 1}"] if k + 1 < length else []) + ([f"V_{k + 1}"] if s == "E" and k + 1 < length else [])
            nodes.append({"vertex": f"{s}_{k}", "signal": s, "idx": k, "vals": ["x", "y", "z"][: 2 + (s == "E")], "children": children})
    vals = {n["vertex"]: n["vals"] for n in nodes}
    for n in nodes:
        for c in n["children"]:
            weights += [{"src": n["vertex"], "src_val": a, "dst": c, "dst_val": b, "w": float(rng.random())} for a in n["vals"] for b in vals[c]]
    return nodes, weights


def _patterns(seed, n=60):
    rng = np.random.default_rng(seed)
    tokens = ["E:x", "E:y", "E:z", "V:x", "V:y"]
    for _ in range(n):
        p = letters([tokens[int(i)] for i in rng.integers(0, 5, 3)], rng.random(3) < 0.5)
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(1, 5))
            p = merged(p, [tokens[int(i)] for i in rng.integers(0, 5, k)], list(rng.random(k) < 0.5))
        if sum(s["kind"] != OPTION for s in p) >= 2:
            yield p


def test_match_weights_equal_walking():
    net = matching.Network(*_network(3))
    seen = 0
    for p in _patterns(5):
        states = matching.satisfying(p, net)
        want = brute_matches(p, states, net)
        n, least = matching.match_weights(p, states, net) if states else (0, None)
        assert n == len(want) and (least is None) == (not want)
        assert least is None or least == pytest.approx(min(want))
        seen += n > 0
    assert seen > 10


def test_satisfying_states_equal_the_model_checker(spark):
    nodes, weights = _network(3)
    net = matching.Network(nodes, weights)
    parents = {n["vertex"]: [m["vertex"] for m in nodes if n["vertex"] in m["children"]] for n in nodes}
    v = checkpointed(spark.createDataFrame([("m", n["vertex"], n["signal"], n["idx"], parents[n["vertex"]], n["vals"]) for n in nodes], "model_id string, vertex string, signal string, idx int, parents array<string>, vals array<string>"))
    k = lg.of_network(v, network.edges(v).union(network.boundary_edges(v)))
    index = {n["vertex"]: n["vals"] for n in nodes}

    def formula(p):
        last = max(i for i, s in enumerate(p) if s["kind"] != OPTION)
        f = None
        for s in reversed(p[: last + 1]):
            here = patterns._any_of(s)
            f = here if f is None else ("EU", here, f) if s["kind"] == OPTION else ("and", here, ("EX", f))
        return f

    for p in list(_patterns(9, 30))[:4]:
        got = {f"m/{v}:{index[v].index(x)}" for v, x in matching.satisfying(p, net)}
        assert got == {r.state for r in k.sat(formula(p)).collect()}


def plain_miners(found, judges):
    """Both miners by one loop over paths, as lists of (path, probability, formula, members)."""
    out = {"cb": [], "mb": []}
    tries = {}
    for r in found:
        tries.setdefault((r["model_id"], r["path_id"]), []).append(r)
    for model in sorted({m for m, _ in tries}):
        for miner in out:
            kept = []
            for _, steps in sorted((x for x in tries.items() if x[0][0] == model), key=lambda x: x[0][1]):
                steps = sorted(steps, key=lambda r: r["step"])
                for n in range(1, len(steps) + 1):
                    r, merged_paths = steps[n - 1], frozenset(s["member"] for s in steps[:n])
                    if any(k[3] <= merged_paths for k in kept):
                        break
                    if miner == "cb":
                        if not r["compared"] or sum(s["kind"] != OPTION for s in r["symbols"]) < 2:
                            break
                        net, most = judges[model]
                        states = matching.satisfying(r["symbols"], net)
                        if not states:
                            continue
                        means = brute_matches(r["symbols"], states, net)
                        good = means and len(means) <= most and min(means) < 1 - r["theta"]
                    else:
                        if r["by_metric"] == 0:
                            continue
                        good = r["by_metric"] > 0
                    if good:
                        try:
                            f = linear_formula(r["symbols"])
                        except IndexError:
                            break
                        if f is not None or miner == "mb":
                            kept = [k for k in kept if not merged_paths <= k[3]] + [(model, r["path_id"], None if f is None else lg.text(f), merged_paths)]
                    break
            out[miner] += [(m, i, f, len(x)) for m, i, f, x in kept]
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_miners_equal_a_plain_loop(spark, sf_dir):
    found, judges = catalog_mining._mined(spark, sf_dir)
    rows = [r.asDict(recursive=True) for r in found.collect()]
    nets = {r["model_id"].rpartition("/")[0]: (matching.Network(r["nodes"], r["weights"]), r["n_paths"]) for r in (x.asDict(recursive=True) for x in judges.collect())}
    want = plain_miners(rows, nets)
    got = {"cb": catalog_mining._judged(found, judges), "mb": mining.metric_based(found)}
    for name, specs in got.items():
        assert sorted([(r.model_id.rpartition("/")[0] or r.model_id, r.path_id, r.ltl, r.n_merged) for r in specs.collect()], key=str) == want[name]
    assert want["mb"] or want["cb"]


def test_linear_formulas():
    def formula(*sequences):
        p = letters(sequences[0], [False] * len(sequences[0]))
        for s in sequences:
            p = merged(p, list(s), [False] * len(s))
        f = linear_formula(p)
        return None if f is None else (lg.text(f), *patterns.formula_size(f))

    assert formula("ACE", "CE") == ("G(X(F((C and X(F(E))))))", 4, 2, 2)  # no premise: operators over names alone don't count
    assert formula("AB") == ("G((A --> X(F(B))))", 3, 2, 2)
    assert formula("AB", "CB") == ("G(((A or C) --> X(F(B))))", 3, 3, 3)
    assert formula("ABAC") == ("G((A --> X(G((B --> X(F((A and X(F(C))))))))))", 9, 4, 3)  # A comes again: B is premise, too
    assert formula("AA") is None
    s = lambda t, kind, x: {"tokens": list(t), "kind": kind, "xable": x}
    assert lg.text(linear_formula([s("A", LETTER, True), s("B", OPTION, True), s("C", LETTER, True)])) == "G((A --> X((B U C))))"
    assert lg.text(linear_formula([s("A", LETTER, True), s("B", OPTION, True), s("C", LETTER, False)])) == "G((A --> X(F(C))))"
    assert lg.text(linear_formula([s("A", LETTER, True), s("B", OPTION, False), s("D", OPTION, True), s("C", LETTER, True), s("E", GROUP, True)])) == "G((A --> X(F((B U (D U (C and X(E))))))))"


def holds(f, word, loop):
    """The truth of a path formula at each place of a word whose last place is followed by place ``loop``."""
    n = len(word)
    after = lambda i: i + 1 if i + 1 < n else loop
    if isinstance(f, str):
        return [f in x for x in word]
    if f == lg.TRUE:
        return [True] * n
    op, *args = f
    v = [holds(x, word, loop) for x in args]
    if op == "not":
        return [not x for x in v[0]]
    if op in ("or", "and", "imply"):
        return [{"or": a or b, "and": a and b, "imply": not a or b}[op] for a, b in zip(*v, strict=True)]
    if op == "X":
        return [v[0][after(i)] for i in range(n)]
    a, b = {"F": ([True] * n, v[0]), "G": (v[0], [False] * n)}.get(op, (v[0], v[-1]))
    weak = op in ("G", "W")
    if op == "R":  # b up to a place with both, or for ever
        a, b, weak = v[1], [x and y for x, y in zip(*v, strict=True)], True
    out = [weak] * n
    for _ in range(2 * n):
        out = [b[i] or (a[i] and out[after(i)]) for i in range(n)]
    return out


def test_linear_time_equals_all_lassos(spark):
    from specloom.operators import linear

    edges = [(0, 1), (0, 2), (1, 0), (1, 3), (2, 2), (2, 3), (3, 1), (3, 3)]
    labels = {0: "p", 1: "pq", 2: "q", 3: ""}
    k = lg.Kripke(
        spark.createDataFrame([(f"s{i}",) for i in labels], "state string"), spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in edges], "src string, dst string"),
        spark.createDataFrame([(f"s{i}", x) for i, t in labels.items() for x in t], "state string, ap string"),
    )
    lassos = []
    for n in range(1, 7):
        for way in itertools.product(range(4), repeat=n):
            if all((a, b) in edges for a, b in itertools.pairwise(way)):
                lassos += [(way, j) for j in range(n) if (way[-1], way[j]) in edges]
    formulas = [("G", ("F", ("and", "p", "q"))), ("and", ("F", ("G", "q")), ("X", ("not", "p"))), ("R", "p", ("or", "q", ("X", "p"))), ("U", ("not", "q"), ("and", "q", ("X", ("U", "p", "q"))))]
    for f in formulas:
        want = {f"s{w[0]}" for w, j in lassos if holds(f, [labels[x] for x in w], j)[0]}
        assert {r.state for r in linear.some_way(k, f).collect()} == want
    inner = ("E", ("G", "q"))
    want = {f"s{w[0]}" for w, j in lassos if holds(("F", "r"), [{2: "r"}.get(x, "") for x in w], j)[0]}  # only s2 can stay in q
    assert {r.state for r in linear.check(k, ("E", ("F", inner))).collect()} == want
    with pytest.raises(TypeError):
        linear.some_way(k, ("EX", "p"))


def test_until_variant_and_fairness(spark):
    k = lg.Kripke(
        spark.createDataFrame([(str(i),) for i in range(1, 5)], "state string"), spark.createDataFrame([("1", "2"), ("2", "3"), ("4", "4"), ("3", "3")], "src string, dst string"),
        spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), ("4", "q")], "state string, ap string"),
    )
    states = lambda d: {r.state for r in d.collect()}
    assert states(k.sat(("EU", "p", "q"))) == {"1", "2", "3", "4"}
    narrow = lg.Kripke(k.states, k.transitions, k.labels, collapsed=True)
    assert states(narrow.sat(("EU", "p", "q"))) == {"3", "4"}
    fewer = lg.Kripke(k.states, k.transitions, k.labels.where("state <> '4'"), collapsed=True)
    assert states(fewer.sat(("EU", "p", "q"))) == {"1", "2", "3"}
    fair = k.under(["q"])
    assert states(fair.sat(("EG", "q"))) == {"3", "4"} and states(k.under(["p"]).sat(("EF", "p"))) == set() and states(fair.sat(("AF", "q"))) == {"1", "2", "3", "4"}
    name, labelled = k.labelled_fair(["q"])
    assert name == "fair" and states(labelled.sat("fair")) == {"1", "2", "3", "4"} and labelled.labelled_fair(["p"])[0] == "fair0"
    assert states(k.next(k.sat("p"))) == {"2", "3"} and k.substructure(k.sat("q")).labels.count() == 2
    kept, whole = k.substructure(k.sat("q")), states(k.sat("q"))
    assert states(kept.states) == whole
    assert {(t.src, t.dst) for t in kept.transitions.collect()} == {(t.src, t.dst) for t in k.transitions.collect() if t.src in whole and t.dst in whole}
    assert sorted(map(tuple, kept.labels.collect())) == sorted(tuple(x) for x in k.labels.collect() if x.state in whole)


def test_components_equal_closure(spark):
    from specloom.operators.graphs import strong_components

    rng = np.random.default_rng(6)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 24, (34, 2))}
    reach = {n: {n} for e in edges for n in e}
    for _ in range(24):
        for a, b in edges:
            for n in reach:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    got = strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_edges_and_parser_refuse(spark):
    from specloom.operators import boolfn

    e = spark.createDataFrame([("m", "a", "b")], "model_id string, src string, dst string")
    assert network.with_edges(e, e.selectExpr("model_id", "dst AS src", "src AS dst")).count() == 2
    with pytest.raises(Exception, match="there already"):
        network.with_edges(e, e).collect()
    for bad in ("a & b", "lambda a: a + 1", "lambda a: b"):
        with pytest.raises(ValueError):
            boolfn.parsed(bad)


def test_gibbs_chains_equal_a_plain_loop(spark):
    """Every draw of every chain again, from the tables and the same uniforms."""
    import hashlib

    from specloom.operators import sampling

    t, _ = worked(spark)
    order = [("A_0", []), ("B_0", []), ("A_1", ["A_0"]), ("B_1", ["B_0", "A_0"])]
    table = {}
    for r in t.collect():
        table.setdefault((r.vertex, tuple(r.parent_vals)), []).append((r.outcome_idx, r.outcome, r.p))
    row = lambda v, state: [(x, p) for _, x, p in sorted(table[v, tuple(state[q] for q in dict(order)[v])])]
    u = lambda *key: int(hashlib.md5("|".join(key).encode()).hexdigest()[:8], 16) / 2**32
    ids = spark.createDataFrame([("m", str(i)) for i in range(25)], "model_id string, sample_key string")
    want = {}
    for i in range(25):
        state = {}
        for v, _ in order:
            cumulative, state[v] = 0.0, None
            for x, p in row(v, state):
                cumulative += p
                state[v] = x if state[v] is None and cumulative > u("0", str(i), v) else state[v]
            if v == "B_0":
                state[v] = "b1"
        for sweep in range(2):
            for v in ("A_0", "A_1", "B_1"):
                weights = []
                for x, p in row(v, state):
                    other = state | {v: x}
                    weights.append((x, p * np.prod([dict(row(c, other))[state[c]] for c, theirs in order if v in theirs])))
                goal, s, new = sum(w for _, w in weights) * u("0", str(i), v, str(sweep)), 0.0, None
                for x, w in weights:
                    s += w
                    new = x if new is None and s > goal else new
                state[v] = new or state[v]
        want[str(i)] = tuple(state[v] for v, _ in order)
    got = sampling.gibbs(t, ids, order, 2, {"B_0": "b1"})
    assert {r.sample_key: tuple(r[v] for v, _ in order) for r in got.collect()} == want
    some, others = (sorted(map(tuple, sampling.ancestral(t, ids, order, most_rows=n).select("sample_key", *dict(order)).collect())) for n in (100_000, 0))
    assert some == others


def test_gibbs_by_a_table_of_combinations_equals_weights_in_rows(spark):
    """Also where a child lacks a probability, so that a vertex keeps its value."""
    from specloom.operators import sampling

    t, _ = worked(spark)
    order = [("A_0", []), ("B_0", []), ("A_1", ["A_0"]), ("B_1", ["B_0", "A_0"])]
    ids = spark.createDataFrame([("m", str(i)) for i in range(40)], "model_id string, sample_key string")
    gap = t.where("NOT (vertex = 'A_1' AND outcome_idx = 1)")
    for tables in (t, gap):
        some, others = (sorted(map(tuple, sampling.gibbs(tables, ids, order, 2, {"B_0": "b1"}, most_rows=n).select("sample_key", *dict(order)).collect())) for n in (100_000, 0))
        assert some == others and len(some) == 40
    rows = sampling._conditionals(t, order, ["A_0", "A_1", "B_1"]).collect()
    assert len(rows) == len({(r.model_id, r._key) for r in rows}) and len({r._key.split("|")[0] for r in rows}) == 3


def test_model_files_and_factor_errors(spark, tmp_path):
    from specloom.operators import factors
    from specloom.sources import tables

    t, v = worked(spark)
    tables.write_model_files(v, f"file://{tmp_path}/models")
    read = tables.read_model_files(spark, f"file://{tmp_path}/models")
    assert sorted((r.src, r.dst) for r in tables.skeleton(read)[1].collect()) == [("A_0", "A_1"), ("A_0", "B_1"), ("B_0", "B_1")]
    assert {r.vertex: (r.vals, r.parents, r.children) for r in tables.node_data(read).collect()}["A_0"] == (["a0", "a1"], [], ["A_1", "B_1"])
    assert [r.vertex for r in tables.ordered_skeleton(read, 3).orderBy("place").collect()] == ["A_0", "B_0", "A_1", "B_1"]
    with pytest.raises(ValueError, match="no value"):
        factors.reduce(factors.factor(t, "A_1", ["A_0"]), "A_0", "nothing")


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row[-1]


def test_rings_hold_every_distance_once(spark):
    """Sequences of 0 to 7 tokens, with repeated tokens and equal sequences, in two models."""
    import random

    from specloom.operators import edit

    rng = random.Random(6)
    seqs = {(m, i): [rng.choice(["a", "b", "cc", "d"][: 2 + rng.randrange(3)]) for _ in range(rng.randrange(8))] for m in "mn" for i in range(40)}
    index = edit.indexed(spark.createDataFrame([(m, i, s) for (m, i), s in seqs.items()], "model_id string, path_id int, tokens array<string>"))
    some = spark.createDataFrame([(m, i) for m, i in seqs if i % 3 == 0], "model_id string, path_id int")
    for d in range(8):
        got = sorted((r.model_id, r.a, r.b) for r in edit.ring(some, index, d).collect())
        assert got == sorted((m, i, j) for (m, i), s in seqs.items() if i % 3 == 0 for (o, j), t in seqs.items() if o == m and plain_distance(s, t) == d)


def test_attempts_equal_runs_over_all_pairs(spark, sf_dir):
    """Rings give the runs that merging in the order of a table of all distances gives."""
    from specloom import catalog
    from specloom.operators import edit

    networks = catalog._learned(spark, sf_dir)
    found = checkpointed(mining.flagged(catalog._numbered(spark, sf_dir, networks), patterns.edge_flags(networks[1])))
    order = edit.merge_order(edit.confusion(found)).join(found.select("model_id", F.col("path_id").alias("b"), "tokens", "xable"), ["model_id", "b"])
    runs = patterns.merge_runs(order.select(F.concat_ws("/", "model_id", "a").alias("key"), F.col("place").alias("ord"), "tokens", "xable"))
    plain = lambda df: sorted(str(r) for r in df.collect())
    got = mining.attempts(found).select(F.concat_ws("/", "model_id", "path_id").alias("key"), "step", "symbols")
    assert plain(got) == plain(runs.select("key", "step", "symbols"))


def test_order_of_some_vertices_follows_edges_between_them_only(spark):
    from specloom.operators.network import ordered

    e = spark.createDataFrame([("m", "d", "c"), ("m", "c", "b"), ("m", "b", "a"), ("m", "d", "a"), ("n", "a", "b")], "model_id string, src string, dst string")
    v = spark.createDataFrame([("m", x) for x in "abcd"] + [("n", x) for x in "ab"], "model_id string, vertex string")
    order = lambda df: [(r.model_id, r.vertex) for r in df.orderBy("model_id", "place").collect()]
    assert order(ordered(e, v, 4)) == [("m", "d"), ("m", "c"), ("m", "b"), ("m", "a"), ("n", "a"), ("n", "b")]
    only = spark.createDataFrame([("m", "b"), ("m", "d"), ("m", "a"), ("m", "a"), ("m", "x")], "model_id string, vertex string")
    # Without c nothing orders d before b, so names do; a comes after both.
    assert order(ordered(e, v, 4, only)) == [("m", "b"), ("m", "d"), ("m", "a")]
