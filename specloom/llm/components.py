"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, settle


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (or itself)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    # Written first, so that the join has plain shuffles on both sides and a node with many links can be split.
    least = settle(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), "least")
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), F.col("w").alias("b"))
    rest = links.join(least, F.col("b") == F.col("w")).where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.union(rest).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``links`` (columns a, b): the smallest node that can be reached.

    Links stay in tables; each round reads the one before it from the shared folder, and rounds grow with the logarithm
    of the longest chain. Minima are aggregated in tasks before the shuffle, so a node with many links is one row a task.

    Defined cases: links with a null end, and links of a node with itself, are left out (a node that has no other isn't in the result); repeated
    links count once; no links give no rows.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = settle(links, "links")
    while True:
        after = settle(_small_star(_large_star(links)), "links")
        same = after.count() == links.count() and not after.join(links, ["a", "b"], "left_anti").limit(1).count()
        drop(links)
        links = after
        if same:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())
