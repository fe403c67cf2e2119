"""Patterns against a network: the states that satisfy a pattern's branching-time formula, and the weights of its matches.

A network comes as a row: ``nodes`` (vertex, signal, idx, vals, children) and ``weights`` (src, src_val, dst, dst_val, w), both as small as the network. A
pattern is an array of symbols as in ``patterns``. Both functions are for one row inside a task; Spark deals out the patterns.
"""

from __future__ import annotations

from .patterns import OPTION


class Network:
    def __init__(self, nodes, weights):
        self.children = {n["vertex"]: list(n["children"]) for n in nodes}
        self.signal = {n["vertex"]: n["signal"] for n in nodes}
        self.after = {n["vertex"]: next((c for c in n["children"] if self.signal.get(c) == n["signal"]), None) for n in nodes}
        self.states = {(n["vertex"], value): f"{n['signal']}:{value}" for n in nodes for value in n["vals"]}
        self.weight = {(w["src"], w["src_val"], w["dst"], w["dst_val"]): w["w"] for w in weights}

    def named(self, vertex: str, tokens) -> list[str]:
        """The values of a vertex that tokens name."""
        return [value for (v, value), token in self.states.items() if v == vertex and token in tokens]


def satisfying(symbols: list[dict], net: Network) -> set:
    """States (vertex, value) from which the symbols up to the last fixed one follow each other; an option holds for any number of steps."""
    fixed = [i for i, s in enumerate(symbols) if s["kind"] != OPTION]
    if len(fixed) < 2:
        return set()
    reached = None
    for s in reversed(symbols[: fixed[-1] + 1]):
        here = {state for state, token in net.states.items() if token in s["tokens"]}
        if reached is None:
            reached = here
            continue
        goal = set(reached) if s["kind"] == OPTION else set()
        front = reached
        while front:
            ahead = {v for v, _ in front}
            front = {x for x in here if any(c in ahead for c in net.children[x[0]])} - goal
            goal |= front
            if s["kind"] != OPTION:
                break
        reached = goal
    return reached


def match_weights(symbols: list[dict], states: set, net: Network) -> tuple[int, float | None]:
    """How many matches of the pattern (without options at its ends) start in ``states``, and the least mean weight of one.

    A match goes from vertex to child with the symbols' tokens; an option may be passed over, and where no match would follow, the token of an
    option just taken may be repeated along its own signal. Matches are counted, and least sums kept for each number of edges, from the end on.
    """
    fixed = [i for i, s in enumerate(symbols) if s["kind"] != OPTION]
    part = symbols[fixed[0] : fixed[-1] + 1]
    known: dict = {}

    def outlook(i: int, vertex: str, value: str, last: int) -> tuple[int, dict[int, float]]:
        if i == len(part):
            return 1, {0: 0.0}
        key = (i, vertex, value, last)
        if key not in known:
            steps = [(net.weight[vertex, value, c, x], outlook(i + 1, c, x, i)) for c in net.children[vertex] for x in net.named(c, part[i]["tokens"])]
            ways = [outlook(i + 1, vertex, value, last)] if part[i]["kind"] == OPTION else []
            on = net.after[vertex]
            if not any(n for n, _ in [*ways, *(x for _, x in steps)]) and part[last]["kind"] == OPTION and on and (on, value) in net.states:
                steps = [(net.weight[vertex, value, on, value], outlook(i, on, value, last))]
            least: dict[int, float] = {}
            for extra, add, (_, sums) in [(0, 0.0, w) for w in ways] + [(1, w, x) for w, x in steps]:
                for edges, total in sums.items():
                    least[edges + extra] = min(least.get(edges + extra, float("inf")), total + add)
            known[key] = sum(n for n, _ in ways) + sum(x[0] for _, x in steps), least
        return known[key]

    found = [outlook(1, vertex, value, 0) for vertex, value in states]
    means = [total / edges for _, sums in found for edges, total in sums.items() if edges]
    return sum(n for n, _ in found), min(means, default=None)
