"""Connected parts of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the smallest node of its component.

    Alternates the large-star and small-star steps until the edges are stars. Each step takes the minimum of a node's
    neighbours with partial sums before the shuffle, so a node with very many neighbours is never gathered in one place.
    Self-loops, null ends and repeated edges are ignored; no edges give no rows.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def parts(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(root, first, edges, nodes, marks) of every connected part of the edges (id, a, b): its smallest edge id, how many edges and nodes it has, and how many of its nodes are in marked (node).

    A part is a tree if it has one edge less than nodes. An edge from a node to itself counts as an edge, repeated edges as so many.
    """
    ends = edges.select("a").union(edges.select("b")).toDF("node").distinct()
    named = ends.join(components(edges.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut_lineage(named)
    marks = marked.select("node", F.lit(1).alias("mark")).distinct()
    nodes = named.join(marks, "node", "left").groupBy("root").agg(F.count("*").alias("nodes"), F.count("mark").alias("marks"))
    own = edges.join(named.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("edges"))
    return own.join(nodes, "root").select("root", "first", "edges", "nodes", "marks")
