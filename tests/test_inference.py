"""Clique trees and best paths against enumeration."""

import itertools
import random

import pytest

from specloom.operators import cliques as cl
from specloom.operators import paths

CPT = "model_id string, vertex string, parents array<string>, parent_vals array<string>, outcome string, outcome_idx int, p double"
VERTICES = "model_id string, vertex string, parents array<string>, vals array<string>"


def random_network(rng, name, n, most_parents):
    names = [f"X_{i}" for i in range(n)]
    vals = {v: [f"{v}{k}" for k in range(rng.choice([2, 2, 3]))] for v in names}
    parents = {v: rng.sample(names[:i], min(i, rng.randrange(most_parents + 1))) for i, v in enumerate(names)}
    cpt = []
    for v in names:
        for given in itertools.product(*(vals[p] for p in parents[v])):
            w = [rng.choice([0.0, rng.random()]) if k else rng.random() for k in range(len(vals[v]))]
            cpt += [(name, v, parents[v], list(given), o, i, x / sum(w)) for i, (o, x) in enumerate(zip(vals[v], w, strict=True))]
    return vals, parents, cpt


def enumerated(vals, parents, cpt, evidence):
    p = {(v, tuple(g), o): x for _, v, _, g, o, _, x in cpt}
    names, total, out = list(vals), 0.0, {}
    for combo in itertools.product(*vals.values()):
        x = dict(zip(names, combo, strict=True))
        if any(x[v] != o for v, o in evidence.items()):
            continue
        w = 1.0
        for v in names:
            w *= p[v, tuple(x[q] for q in parents[v]), x[v]]
        total += w
        for v, o in x.items():
            out[v, o] = out.get((v, o), 0.0) + w
    return {k: w / total for k, w in out.items()} if total else {}


def test_exact_marginals_of_many_structures(spark):
    """Ten networks of different structures in one job, some in several parts, with and without evidence."""
    rng, cpt, vertices, want, wanted, seen = random.Random(11), [], [], {}, {}, []
    for m in range(10):
        vals, parents, rows = random_network(rng, f"m{m}", rng.randrange(1, 8), m % 4)
        cpt += rows
        vertices += [(f"m{m}", v, parents[v], vals[v]) for v in vals]
        last = max(vals)
        seen.append((f"m{m}", last, vals[last][0]))
        want |= {(f"m{m}", *k): p for k, p in enumerated(vals, parents, rows, {}).items()}
        wanted |= {(f"m{m}", *k): p for k, p in enumerated(vals, parents, rows, {last: vals[last][0]}).items()}
    t, v = spark.createDataFrame(cpt, CPT), spark.createDataFrame(vertices, VERTICES)
    got = {(r.model_id, r.vertex, r.outcome): r.p for r in cl.exact_marginals(t, v).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    given = {(r.model_id, r.vertex, r.outcome): r.p for r in cl.exact_marginals(t, v, spark.createDataFrame(seen, "model_id string, vertex string, outcome string")).collect()}
    assert {k: p for k, p in given.items() if p} == pytest.approx({k: p for k, p in wanted.items() if p})


def test_cliques_hold_families_and_run_together():
    rng = random.Random(2)
    for n in range(1, 12):
        vals, parents, _ = random_network(rng, "m", n, 3)
        cliques = cl.elimination_cliques(parents, {v: len(x) for v, x in vals.items()})
        tree = cl.rooted_tree(cliques)
        assert all(any({v, *p} <= c for c in cliques) for v, p in parents.items()) and sum(up < 0 for up, _ in tree) == 1
        for v in vals:  # the cliques of a vertex are connected: one of them alone has none of the others above it
            having = {i for i, c in enumerate(cliques) if v in c}
            assert sum(tree[i][0] not in having for i in having) == 1


def test_a_clique_beyond_the_bound_is_an_error(spark):
    vals, parents, rows = random_network(random.Random(1), "m", 6, 3)
    v = spark.createDataFrame([("m", x, parents[x], vals[x]) for x in vals], VERTICES)
    with pytest.raises(Exception, match="too large"):
        cl.exact_marginals(spark.createDataFrame(rows, CPT), v, most=3).collect()


@pytest.mark.parametrize("k", [1, 3, 40])
def test_k_best_equals_enumeration(spark, k):
    """Two models; the second has ties and states that lead nowhere."""
    rng, weights, states, boundary, want = random.Random(k), [], [], [], {}
    for m, pick in (("a", rng.random), ("b", lambda: rng.choice([0.25, 0.5]))):
        names = [f"{s}_{i}" for i in range(3) for s in "PQ"]
        states += [(m, v, x) for v in names for x in "xy"]
        boundary += [(m, "start", "P_0"), (m, "start", "Q_0"), (m, "P_2", "terminal"), (m, "Q_2", "terminal")]
        own = {}
        for i in range(2):
            for a, b, x, y in itertools.product("PQ", "PQ", "xy", "xy"):
                if rng.random() < 0.7:
                    own[(f"{a}_{i}", x), (f"{b}_{i + 1}", y)] = pick()
        weights += [(m, a[0], a[1], b[0], b[1], w) for (a, b), w in own.items()]
        walks = [[(f"{s}_0", x)] for s in "PQ" for x in "xy"]
        full = []
        while walks:
            walk = walks.pop()
            if walk[-1][0].endswith("_2"):
                full.append((sum(own[e] for e in itertools.pairwise(walk)) / (len(walk) - 1), walk))
            walks += [[*walk, b] for (a, b) in own if a == walk[-1]]
        want[m] = sorted(w for w, _ in full)[:k], {tuple(walk): w for w, walk in full}
    w = spark.createDataFrame(weights, "model_id string, src string, src_val string, dst string, dst_val string, w double")
    s = spark.createDataFrame(states, "model_id string, v string, val string")
    found = paths.k_best(w, spark.createDataFrame(boundary, "model_id string, src string, dst string"), s, 2, k).orderBy("model_id", "place").collect()
    for m, (metrics, walks) in want.items():
        rows = [r for r in found if r.model_id == m]
        assert [r.metric for r in rows] == pytest.approx(metrics) and [r.place for r in rows] == list(range(1, len(metrics) + 1))
        nodes = [tuple((x.v, x.val) for x in r.nodes) for r in rows]
        assert len(set(nodes)) == len(nodes) and [walks[n] for n in nodes] == pytest.approx(metrics)
    assert not paths.k_best(w.limit(0), spark.createDataFrame(boundary, "model_id string, src string, dst string").select("model_id", "src", "dst"), s, 2, k).count()
