"""Connected components of a graph of any size, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repo_signals.session import materialize


def stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the smaller and own) neighbours of every node on its smallest neighbour.

    Minima are pre-aggregated in each task, and the join back is one that Spark
    splits where a node has very many neighbours.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        hung = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        # Every edge is kept as (greater, smaller).
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        joined = edges.join(low, "a")
        hung = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return hung.where(F.col("a") != F.col("b")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (greater, smaller) is either a centre or hangs on one alone."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1)).alias("n")).first()["n"] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is named by its smallest node.

    Each round is a written table, so lost executors cost a read, and only one
    number per round reaches the driver. The number of rounds grows with the
    logarithm of the longest path.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = materialize(links.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not are_stars(edges):
        edges = materialize(stars(stars(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def with_more_links(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, component)`` after more links, as a written table: only the graph of the components that they touch is worked on."""
    if components is None:
        return materialize(connected_components(links), "components")

    def component_of(end: str) -> DataFrame:
        return components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))

    ends = links.join(component_of("a"), "a", "left").join(component_of("b"), "b", "left")
    parts = [F.coalesce(f"{end}_part", end).alias(end) for end in ("a", "b")]
    joined = materialize(connected_components(ends.select(*parts)), "joined")
    # What a component is now part of; nodes that are new are components of their own.
    now = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = components.join(now, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = joined.join(components.select("node"), "node", "left_anti")
    return materialize(known.union(new), "components")
