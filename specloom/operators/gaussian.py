"""Linear Gaussian vertices learned from data: for each combination of discrete parents a normal whose mean is linear in the continuous parents.

A vertex's table has rows (*discrete parents, n, mean_base, mean_scal, variance). Learning is one aggregation: means, variances and covariances, summed in tasks
before the shuffle, so a hot combination is a row a task. What each group solves, the normal equations, is as large as the square of the
number of parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import gaussian, normal

CLEARED_VARIANCE = 0.1


def fit(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """Least squares of ``y`` on ``xs`` for each group of ``by``; rows with a null or NaN among them are left out. Parents that say nothing beside the others (constant, or
    combinations of them) share the smallest factors; ``variance`` is the mean squared residual."""
    whole = F.lit(True)
    for c in (y, *xs):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = rows.where(whole).select(*by, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate((y, *xs))])
    k = len(xs)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(f"_{i}") for i in range(k + 1)]).alias("_m"), F.array(*[F.covar_pop(f"_{i}", f"_{j}") for i, j in pairs]).alias("_c"))
    schema = sums.drop("_m", "_c").withColumn("mean_base", F.lit(0.0)).withColumn("mean_scal", F.array(F.lit(0.0))).withColumn("variance", F.lit(0.0)).schema

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            mean = b.column(b.schema.get_field_index("_m")).flatten().to_numpy(zero_copy_only=False).reshape(n, k + 1)
            flat = b.column(b.schema.get_field_index("_c")).flatten().to_numpy(zero_copy_only=False).reshape(n, len(pairs))
            cov = np.zeros((n, k + 1, k + 1))
            for p, (i, j) in enumerate(pairs):
                cov[:, i, j] = cov[:, j, i] = flat[:, p]
            factor = (np.linalg.pinv(cov[:, 1:, 1:], rcond=1e-10, hermitian=True) @ cov[:, 1:, :1])[:, :, 0] if k and n else np.zeros((n, k))
            base = mean[:, 0] - (factor * mean[:, 1:]).sum(axis=1)
            variance = np.maximum(cov[:, 0, 0] - (factor * cov[:, 1:, 0]).sum(axis=1), 0.0)
            kept = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name not in ("_m", "_c")]
            scal = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(factor.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base), scal, pa.array(variance)], [f.name for f in schema])

    return sums.mapInArrow(solve, schema)


def draws(rows: DataFrame, fitted: DataFrame, by: list[str], xs: list[str], key: list, name: str = "draw", default: float = 0.0, small: int = 10_000) -> DataFrame:
    """Adds a draw of the fitted vertex to rows with its parents: the group's normal, its mean moved by factor * parent; a null parent counts as ``default``. ``key``:
    columns that name a row; they decide its random number. Rows whose group wasn't learned get null. Groups are broadcast up to ``small`` of them."""
    groups = fitted.select(*by, "mean_base", "mean_scal", "variance")
    groups = F.broadcast(groups) if groups.count() <= small else groups
    joined = rows.join(groups, by, "left")
    terms = [(F.get("mean_scal", F.lit(i)), F.coalesce(F.col(x).cast("double"), F.lit(default))) for i, x in enumerate(xs)]
    return joined.withColumn(name, gaussian(F.col("mean_base"), F.col("variance"), normal(*key), terms)).drop("mean_base", "mean_scal", "variance")


def cleared(fitted: DataFrame) -> DataFrame:
    """The same rows without what was learned: mean 0, no factors, a small variance."""
    return fitted.withColumn("mean_base", F.lit(0.0)).withColumn("mean_scal", F.transform("mean_scal", lambda _: F.lit(0.0))).withColumn("variance", F.lit(CLEARED_VARIANCE))
