"""Computation-tree logic over a transition table: formulas become semi-joins and fixpoints.

A structure is states (state), transitions (src, dst) with a successor for every state, and labels (state, ap). A formula is
a nested tuple: a name, ("not", f), ("or", f, g), ("and", f, g), ("imply", f, g), ("EX", f), ("EU", f, g), ("EG", f), and the
operators derived from these. ``sat`` returns the states (state) in which it holds.

Under fairness conditions (``under``) quantifiers range over the ways that meet every condition again and again. ``collapsed`` switches to a
variant of until in which a goal state that no step within or into the first argument's states touches reduces the result to the goals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .graphs import reachable, reversed_graph, strong_components
from .network import START, TERMINAL

TRUE = ("true",)


def rewritten(f):
    """The same formula in terms of not, or, EX, EU, EG."""
    if isinstance(f, str) or f == TRUE:
        return f
    op, *args = f
    no = lambda x: ("not", x)
    if op in ("not", "or", "EX", "EU", "EG"):
        return (op, *map(rewritten, args))
    a, b = (args + [None])[:2]
    derived = {
        "and": lambda: no(("or", no(a), no(b))), "imply": lambda: ("or", no(a), b), "EF": lambda: ("EU", TRUE, a), "AX": lambda: no(("EX", no(a))), "AF": lambda: no(("EG", no(a))), "AG": lambda: no(("EU", TRUE, no(a))),
        "AU": lambda: no(("or", ("EU", no(b), no(("or", a, b))), ("EG", no(b)))), "ER": lambda: no(("AU", no(a), no(b))), "AR": lambda: no(("EU", no(a), no(b))), "EW": lambda: ("or", ("EU", a, b), ("EG", a)), "AW": lambda: no(("EU", no(b), no(("or", a, b)))),
    }
    return rewritten(derived[op]())


def text(f) -> str:
    """A formula as text."""
    if isinstance(f, str):
        return f
    op, *args = f
    infix = {"or": "or", "and": "and", "imply": "-->", "U": "U", "R": "R", "W": "W"}
    if op in infix:
        return f"({text(args[0])} {infix[op]} {text(args[1])})"
    if op in ("EU", "AU", "ER", "AR", "EW", "AW"):
        return f"{op[0]}({text(args[0])} {op[1]} {text(args[1])})"
    return op if not args else f"{op}({text(args[0])})"


def height(f) -> int:
    return 0 if isinstance(f, str) or f == TRUE else 1 + max(map(height, f[1:]))


@dataclass
class Kripke:
    states: DataFrame
    transitions: DataFrame
    labels: DataFrame
    memo: dict = field(default_factory=dict)
    conditions: tuple = ()
    collapsed: bool = False

    def under(self, conditions: list) -> Kripke:
        """The same structure with quantifiers over fair ways only. Conditions themselves are judged on all ways."""
        return Kripke(self.states, self.transitions, self.labels, conditions=tuple(conditions), collapsed=self.collapsed)

    def next(self, states: DataFrame) -> DataFrame:
        """Successors (state) of ``states``."""
        return self.transitions.join(states.select(F.col("state").alias("src")), "src", "left_semi").select(F.col("dst").alias("state")).distinct()

    def labelled(self, sat: DataFrame, name: str) -> tuple[str, Kripke]:
        """The structure with the label ``name`` at the states ``sat``; a number is added to a name that is taken."""
        taken = {r.ap for r in self.labels.select("ap").where(F.col("ap").startswith(name)).distinct().collect()}
        free = next(x for x in [name, *(f"{name}{i}" for i in range(len(taken) + 1))] if x not in taken)
        return free, Kripke(self.states, self.transitions, checkpointed(self.labels.select("state", "ap").union(sat.select("state", F.lit(free).alias("ap")))))

    def labelled_fair(self, conditions: list) -> tuple[str, Kripke]:
        """A new label for the states from which a fair way leads."""
        return self.labelled(self.fair_states(conditions), "fair")

    def checked(self) -> Kripke:
        """Raises ValueError if a state has no successor."""
        stuck = self.states.join(self.transitions.select(F.col("src").alias("state")), "state", "left_anti").limit(1).count()
        if stuck:
            raise ValueError("the transition relation is not total")
        return self

    def substructure(self, kept: DataFrame) -> Kripke:
        t = self.transitions.join(kept.select(F.col("state").alias("src")), "src", "left_semi").join(kept.select(F.col("state").alias("dst")), "dst", "left_semi")
        return Kripke(kept, t, self.labels.join(kept, "state", "left_semi"))

    def fair_states(self, conditions: list) -> DataFrame:
        """States from which a way leads that meets every condition again and again."""
        return self._always(self.states, self.transitions, conditions)

    def _always(self, inside: DataFrame, transitions: DataFrame, conditions: list) -> DataFrame:
        """States of ``inside`` from which a way within ``transitions`` leads that meets every condition again and again."""
        parts = checkpointed(strong_components(transitions))
        looped = parts.groupBy("component").agg(F.count("*").alias("n"))
        loops = transitions.where("src = dst").join(parts, F.col("src") == F.col("node")).select("component").distinct()
        live = looped.where("n > 1").select("component").union(loops).distinct()
        every = Kripke(self.states, self.transitions, self.labels)
        for c in conditions:
            met = every.sat(c).join(parts, F.col("state") == F.col("node")).select("component").distinct()
            live = live.join(met, "component", "left_semi")
        seeds = parts.join(live, "component", "left_semi").select("node")
        return reachable(reversed_graph(transitions), seeds).select(F.col("node").alias("state")).join(inside.select("state"), "state", "left_semi")

    def sat(self, f) -> DataFrame:
        f = rewritten(f)
        if f not in self.memo:
            self.memo[f] = checkpointed(self._sat(f))
        return self.memo[f]

    def _sat(self, f) -> DataFrame:
        if f == TRUE:
            return self.states
        if isinstance(f, str):
            return self.states.join(self.labels.where(F.col("ap") == f), "state", "left_semi")
        op, *args = f
        if op == "not":
            return self.states.join(self.sat(args[0]), "state", "left_anti")
        if op == "or":
            return self.sat(args[0]).union(self.sat(args[1])).distinct()
        if op == "EX":
            return self._before(self._fair(self.sat(args[0])))
        if op == "EU":
            return self._until(self.sat(args[0]), self._fair(self.sat(args[1])))
        left = self.sat(args[0])
        if self.conditions:
            return self._always(left, checkpointed(self._within(left)), list(self.conditions))
        n = left.count()
        while True:  # states lose their place when no successor is left
            left = checkpointed(left.join(self._before(left), "state", "left_semi"))
            if (rest := left.count()) == n:
                return left
            n = rest

    def _fair(self, states: DataFrame) -> DataFrame:
        if not self.conditions:
            return states
        if ("fair ways",) not in self.memo:
            self.memo[("fair ways",)] = checkpointed(self.fair_states(list(self.conditions)))
        return states.join(self.memo[("fair ways",)], "state", "left_semi")

    def _within(self, states: DataFrame) -> DataFrame:
        """Transitions between ``states``."""
        return self.transitions.join(states.select(F.col("state").alias("src")), "src", "left_semi").join(states.select(F.col("state").alias("dst")), "dst", "left_semi").select("src", "dst")

    def _until(self, through: DataFrame, goal: DataFrame) -> DataFrame:
        seen = front = goal
        if self.collapsed:
            touched = self._within(through).select(F.explode(F.array("src", "dst")).alias("state")).union(self.next(through))
            if not goal.join(touched, "state", "left_anti").isEmpty():
                return goal
        while True:
            front = checkpointed(self._before(front).join(through, "state", "left_semi").join(seen, "state", "left_anti"))
            if front.isEmpty():
                return seen
            seen = checkpointed(seen.union(front))

    def _before(self, states: DataFrame) -> DataFrame:
        return self.transitions.join(states.select(F.col("state").alias("dst")), "dst", "left_semi").select(F.col("src").alias("state")).distinct()


def of_network(vertices: DataFrame, edges: DataFrame) -> Kripke:
    """The structure of networks (vertices with signal and vals; edges from start and into terminal included): a state model/vertex:i for each
    value of each vertex, a transition for every edge and pair of values whatever its probability, a loop at each terminal, and signal:value labels.
    Models share no state, so formulas hold for each model as if it were alone."""
    own = vertices.select("model_id", "vertex", "signal", F.posexplode("vals").alias("i", "value"))
    ends = vertices.select("model_id").distinct().select("model_id", F.explode(F.array(F.lit(START), F.lit(TERMINAL))).alias("vertex"))
    own = own.union(ends.select("model_id", "vertex", "vertex", F.lit(0), F.lit("0")))
    own = checkpointed(own.withColumn("state", F.concat("model_id", F.lit("/"), "vertex", F.lit(":"), F.col("i").cast("string"))))
    loops = edges.select("model_id").distinct().select("model_id", F.lit(TERMINAL), F.lit(TERMINAL))
    a, b = (own.select("model_id", F.col("vertex").alias(n), F.col("state").alias(f"{n}_state")) for n in ("src", "dst"))
    t = edges.select("model_id", "src", "dst").union(loops).join(a, ["model_id", "src"]).join(b, ["model_id", "dst"])
    return Kripke(own.select("state"), checkpointed(t.select(F.col("src_state").alias("src"), F.col("dst_state").alias("dst"))), own.select("state", F.concat_ws(":", "signal", "value").alias("ap")))
