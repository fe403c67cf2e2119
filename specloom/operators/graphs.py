"""Directed graphs as edge tables (src, dst): closures, components, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between ``nodes`` (node); nodes without any vanish."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def reversed_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sources(edges: DataFrame) -> DataFrame:
    """Nodes with an edge that leaves them."""
    return edges.select(F.col("src").alias("node")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (node) that can be reached from ``seeds``, these included. Each round joins the new nodes only."""
    edges = checkpointed(edges.distinct())
    seen = front = checkpointed(seeds.select("node").distinct())
    while True:
        front = checkpointed(front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.union(front))


def closure(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) with a way of one edge or more from a to b; ways double in each round."""
    edges = pairs = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    n = pairs.count()
    while True:
        longer = pairs.select("a", F.col("b").alias("m")).join(pairs.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        pairs = checkpointed(pairs.union(longer).distinct())
        if (more := pairs.count()) == n:
            return pairs
        n = more


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node among those that reach each other.

    Nodes without a way in or out are components of their own and go first, layer by layer. Of the others, each takes as colour the smallest node that
    reaches it; what reaches the node of its own colour within the colour is that node's component. It goes, and the rest
    starts anew. Rounds join the nodes that changed last only, and hold no pairs of nodes.
    """
    pairs = edges.select("src", "dst").distinct()
    nodes = checkpointed(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    live = checkpointed(pairs.where("src <> dst"))
    done = None
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            break
        colours = _coloured(live)
        # Within a colour, backwards from the node that gave it.
        own = live.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        found = reachable(reversed_graph(own), colours.where("node = colour").select("node"))
        found = checkpointed(found.join(colours, "node").select("node", F.col("colour").alias("component")))
        done = found if done is None else done.union(found)
        gone = found.select("node")
        live = checkpointed(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out, after all others went."""
    n = edges.count()
    while n:
        into = edges.select(F.col("dst").alias("src")).distinct()
        out = edges.select(F.col("src").alias("dst")).distinct()
        edges = checkpointed(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        if (left := edges.count()) == n:
            break
        n = left
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """Rows (node, colour): the smallest node that reaches each node (itself included)."""
    colours = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour")))
    front = colours
    while True:
        sent = front.withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("sent"))
        front = checkpointed(colours.join(sent, "node").where("sent < colour").select("node", F.col("sent").alias("colour")))
        if front.isEmpty():
            return colours
        colours = checkpointed(colours.join(front.withColumnRenamed("colour", "lower"), "node", "left").select("node", F.coalesce("lower", "colour").alias("colour")))
