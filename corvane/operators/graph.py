"""Connected components by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.workspace import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), where component is the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, compresses the forest by pointer jumping and contracts the
    edges; the roots at least halve. Only joins and min-aggregates are used: no neighbourhood is gathered anywhere.
    """
    ordered = lambda d: d.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(ordered(edges.select("a", "b")), "edges")
    labels = None
    while True:
        parent = stored(edges.groupBy("b").agg(F.min("a").alias("p")).withColumnRenamed("b", "node"), "parents")
        if labels is None:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
            labels = stored(nodes.withColumn("component", F.col("node")), "labels")
        while True:  # pointer jumping: p(v) becomes p(p(v))
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
            jumped = stored(jumped, "parents")
            parent = jumped.select("node", "p")
            if not jumped.filter("moved").head(1):
                break
        to = parent.select(F.col("node").alias("component"), "p")
        labels = stored(labels.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        side = lambda c: parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        moved = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        edges = stored(ordered(moved), "edges")
        if not edges.head(1):
            return labels


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest of (a, b), where each b has one a < b: every node's root, which is the smallest of its tree. By pointer jumping
    alone, so in as many rounds as the logarithm of the depth."""
    p = stored(parents.select(F.col("b").alias("node"), F.col("a").alias("p")), "parents")
    while True:
        up = p.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jumped = p.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        jumped = stored(jumped, "parents")
        p = jumped.select("node", "p")
        if not jumped.filter("moved").head(1):
            break
    top = p.select("p").distinct()
    return p.withColumnRenamed("p", "component").unionByName(top.select(F.col("p").alias("node"), F.col("p").alias("component")))
