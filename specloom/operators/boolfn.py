"""Boolean functions as truth tables: variable columns and a value ``f``. A table is canonical, so equality is set equality."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variables(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "f"]


def apply(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``and``, ``or`` or ``xor`` of two functions, over all variables of both."""
    on = [c for c in variables(a) if c in variables(b)]
    both = a.withColumnRenamed("f", "x").join(b.withColumnRenamed("f", "y"), on)
    value = {"and": F.col("x") & F.col("y"), "or": F.col("x") | F.col("y"), "xor": F.col("x") != F.col("y")}[op]
    return both.withColumn("f", value).drop("x", "y")


def negated(t: DataFrame) -> DataFrame:
    return t.withColumn("f", ~F.col("f"))


def restricted(t: DataFrame, variable: str, value: bool) -> DataFrame:
    return t.where(F.col(variable) == value).drop(variable)


def essential(t: DataFrame) -> DataFrame:
    """Rows (variable): those on which the function depends."""
    rows = None
    for v in variables(t):
        rest = [c for c in variables(t) if c != v]
        one = t.groupBy(*rest).agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low <> high").select(F.lit(v).alias("variable")).distinct()
        rows = one if rows is None else rows.union(one)
    return rows


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equivalent)."""
    b = b.select(a.columns)
    differ = a.exceptAll(b).union(b.exceptAll(a))
    return differ.agg((F.count("*") == 0).alias("equivalent"))


def parsed(source: str) -> tuple[list[str], Column]:
    """The variables and the column expression of a function like ``lambda a, b: a & ~b`` (also with and, or, not, ^, True, False)."""
    f = ast.parse(source, mode="eval").body
    if not isinstance(f, ast.Lambda):
        raise ValueError("a lambda of variables is expected")
    names = [a.arg for a in f.args.args]

    def column(e: ast.expr) -> Column:
        match e:
            case ast.Name(id=name) if name in names:
                return F.col(name)
            case ast.Constant(value=bool(value)):
                return F.lit(value)
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=x):
                return ~column(x)
            case ast.BinOp(left=x, op=ast.BitXor(), right=y):
                return column(x) != column(y)
            case ast.BinOp(left=x, op=ast.BitAnd(), right=y):
                return column(x) & column(y)
            case ast.BinOp(left=x, op=ast.BitOr(), right=y):
                return column(x) | column(y)
            case ast.BoolOp(op=op, values=[first, *more]):
                out = column(first)
                for x in more:
                    out = out & column(x) if isinstance(op, ast.And) else out | column(x)
                return out
        raise ValueError(f"no boolean expression: {ast.unparse(e)}")

    return names, column(f.body)


def table_of(grid: DataFrame, source: str) -> DataFrame:
    """The truth table of a parsed function over a grid of its variables."""
    names, value = parsed(source)
    return grid.select(*names).distinct().withColumn("f", value)
