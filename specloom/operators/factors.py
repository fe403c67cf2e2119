"""Factors as relations: scope columns and a probability ``p``; all models at once by ``model_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "model_id"


def scope(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c not in (KEY, "p")]


def factor(cpt: DataFrame, vertex: str, parents: list[str]) -> DataFrame:
    """The factor of a vertex: a column for it and each parent."""
    rows = cpt.where(F.col("vertex") == vertex)
    return rows.select(KEY, F.col("outcome").alias(vertex), *[F.get("parent_vals", F.lit(i)).alias(pa) for i, pa in enumerate(parents)], "p")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joins on the shared variables (and the model)."""
    on = [KEY, *(c for c in scope(a) if c in scope(b))]
    both = a.join(b.withColumnRenamed("p", "q"), on)
    return both.withColumn("p", F.col("p") * F.col("q")).drop("q")


def sum_out(f: DataFrame, variable: str) -> DataFrame:
    return f.groupBy(KEY, *(c for c in scope(f) if c != variable)).agg(F.sum("p").alias("p"))


def reduce(f: DataFrame, variable: str, value: str) -> DataFrame:
    """The factor given a value of a variable; a value that it doesn't have is an error."""
    rows = f.where(F.col(variable) == value)
    if rows.isEmpty():
        raise ValueError(f"{variable} has no value {value}")
    return rows.drop(variable)


def normalised(f: DataFrame) -> DataFrame:
    return f.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(KEY)))


def eliminate(factors: list[DataFrame], hidden: list[str]) -> DataFrame:
    """Sums out ``hidden``, the variable with the smallest product first, and multiplies what is left."""
    factors, hidden = list(factors), list(hidden)
    while hidden:
        width = lambda v: len({c for f in factors if v in scope(f) for c in scope(f)})  # noqa: B023, E731
        v = min(hidden, key=lambda x: (width(x), x))
        hidden.remove(v)
        own = [f for f in factors if v in scope(f)]
        if own:
            factors = [f for f in factors if v not in scope(f)]
            product = own[0]
            for f in own[1:]:
                product = multiply(product, f)
            factors.append(sum_out(product, v))
    out = factors[0]
    for f in factors[1:]:
        out = multiply(out, f)
    return out


def conditional(factors: list[DataFrame], query: list[str], evidence: dict[str, str]) -> DataFrame:
    """P(query | evidence) in each model."""
    for v, value in evidence.items():
        factors = [reduce(f, v, value) if v in scope(f) else f for f in factors]
    every = {c for f in factors for c in scope(f)}
    return normalised(eliminate(factors, sorted(every - set(query))))


def specific(factors: list[DataFrame], wanted: dict[str, list[str]], evidence: dict[str, str]) -> DataFrame:
    """Chance in each model that each variable is among its wanted values."""
    out = conditional(factors, sorted(wanted), evidence)
    for v, among in wanted.items():
        out = out.where(F.col(v).isin(among))
    return out.groupBy(KEY).agg(F.sum("p").alias("p"))
