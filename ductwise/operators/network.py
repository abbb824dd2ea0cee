"""Trees and chains held as (node, parent) tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.operators import trees
from ductwise.session import cut_lineage


def ancestors(tree: DataFrame, node: str = "node", parent: str = "parent", most: int = 10_000) -> DataFrame:
    """(node, ancestor, depth), the node itself at depth 0. One join for each level; a null or absent parent ends a chain.

    Raises if a chain is longer than `most`, so that a cycle does not run forever. For the whole of every way, which is n * depth
    rows; sums and ends over ways and subtrees are in `trees`.
    """
    up = tree.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    level = tree.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    levels = [level]
    for depth in range(1, most):
        level = level.join(up, level["ancestor"] == up["_n"]).where("_p is not null").select("node", F.col("_p").alias("ancestor"), F.lit(depth).alias("depth"))
        level = cut_lineage(level.join(up.select(F.col("_n").alias("ancestor")), "ancestor", "left_semi").select("node", "ancestor", "depth"))
        if level.isEmpty():
            out = levels[0]
            for x in levels[1:]:
                out = out.unionByName(x)
            return out
        levels.append(level)
    raise RuntimeError(f"a chain is longer than {most}")


def chain_states(tree: DataFrame, roots: list[int], node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, state): `root` if the chain upwards ends in one of the roots, `broken` if in a node that is not there, else `cycle`.

    Pointers are doubled, so a chain of n objects takes log2(n) joins.
    """
    known = tree.select(F.col(node).alias("node"), F.when(F.col(node).isin(roots), F.col(node)).otherwise(F.col(parent)).alias("to"))
    jump = cut_lineage(known.join(known.select(F.col("node").alias("to"), F.lit(True).alias("there")), "to", "left").select("node", F.when(F.col("there"), F.col("to")).alias("to")))
    for _ in range(math.ceil(math.log2(max(2, jump.count()))) + 1):
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.lit(True).alias("_there"))
        jump = cut_lineage(jump.join(ahead, "to", "left").select("node", F.when(F.col("to").isin(roots), F.col("to")).otherwise(F.col("next")).alias("to")))
    state = F.when(F.col("to").isNull(), "broken").when(F.col("to").isin(roots), "root").otherwise("cycle")
    return jump.select("node", state.alias("state"))


def subtree_sums(tree: DataFrame, value: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, total, n, depth): sum of a value over the subtree below each node, itself included. Nodes without an end above them have no row."""
    rows = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(value).alias("total"))
    return trees.gather(rows, sums=["total"]).select("node", "total", F.col("below").alias("n"), "depth")


def islands(df: DataFrame, keys: list[str], order: list[str], changed: Column) -> DataFrame:
    """Adds `island`: how often `changed` has been true so far, in the order, for each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("island", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w))


def equal_runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `island` for consecutive rows with the same value."""
    return islands(df, keys, order, F.col(value) != F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def suffix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of a value from each row to the last of its key: what hangs on the line beyond that place."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def merge_intervals(df: DataFrame, keys: list[str], low: str, high: str, k: str, gap: float = 0.01) -> DataFrame:
    """Union of intervals of a key that overlap or lie no further apart than gap; the larger k holds for all of a union."""
    w = W.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_fresh", F.when(F.col(low) <= reach + gap, 0).otherwise(1)).withColumn("_id", F.sum("_fresh").over(w))
    return marked.groupBy(*keys, "_id").agg(F.min(low).alias(low), F.max(high).alias(high), F.max(k).alias(k)).drop("_id")


def degree(segments: DataFrame, ends: list[str]) -> DataFrame:
    """(node, degree): how many segment ends meet at a node."""
    return segments.select(F.explode(F.array(*ends)).alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def running_length(df: DataFrame, keys: list[str], order: list[str], length: str, out: str = "position") -> DataFrame:
    """Adds how far along its line each piece begins."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)))


def derive_upstream(segments: DataFrame, root: int, source: int, most: int = 10_000) -> DataFrame:
    """(id, upstream, depth) of the segments (id, a, b) that hang together with the root node: the walk from it, level by level.

    upstream is the segment by which the walk came to the end where this one begins; the source at the root. Of several
    segments that lead to a node in one level the smallest id counts. Segments out of reach have no row.
    """
    ends = segments.select("id", F.col("a").alias("at"), F.col("b").alias("to")).unionByName(segments.select("id", F.col("b").alias("at"), F.col("a").alias("to")))
    reached = cut_lineage(segments.sparkSession.createDataFrame([(root, source)], "node long, into long"))
    front, taken, found = reached, None, None
    for depth in range(1, most):
        step = ends.join(front, ends["at"] == front["node"])
        step = step if taken is None else step.join(taken, "id", "left_anti")
        step = cut_lineage(step.groupBy("id").agg(F.min(F.struct("into", "to")).alias("s")).select("id", F.col("s.into").alias("upstream"), F.col("s.to").alias("to"), F.lit(depth).alias("depth")))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        taken = found.select("id")
        fresh = step.groupBy(F.col("to").alias("node")).agg(F.min("id").alias("into")).join(reached.select("node"), "node", "left_anti")
        front = cut_lineage(fresh.select("node", "into"))
        reached = reached.unionByName(front)
    else:
        raise RuntimeError(f"the walk takes more than {most} levels")
    if found is None:
        return segments.sparkSession.createDataFrame([], "id long, upstream long, depth int")
    return found.select("id", "upstream", "depth")


def branch_groups(tree: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """(node, n, shape, length, density) of the nodes with low to high consumers below, densest first, ties to the smaller node.

    The tree holds node, parent, consumer (true for a connection point), shape and length of the edge above the node; the
    group is the node's subtree with the edge above it. Consumers themselves are no groups.
    """
    counted = tree.select("node", "parent", "shape", "length", F.col("consumer").cast("long").alias("n"))
    sums = trees.gather(counted, sums=["n", "shape", "length"]).select("node", "n", "shape", "length")
    groups = sums.where(F.col("n").between(low, high)).join(tree.where("not consumer").select("node"), "node", "left_semi")
    groups = groups.withColumn("density", F.col("shape") / F.nullif(F.col("length"), F.lit(0)))
    return groups.orderBy(F.desc_nulls_last("density"), "node")


def place_names(segments: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(id, place): the upstream segment's id where a segment (id, upstream, sx, sy, ex, ey) goes on from its end, else its own."""
    up = segments.select(F.col("id").alias("_up"), F.col("ex").alias("_x"), F.col("ey").alias("_y"))
    near = (F.col("_x") - F.col("sx")) * (F.col("_x") - F.col("sx")) + (F.col("_y") - F.col("sy")) * (F.col("_y") - F.col("sy")) <= tolerance * tolerance
    return segments.join(up, F.col("upstream") == F.col("_up"), "left").select("id", F.when(near, F.col("_up")).otherwise(F.col("id")).alias("place"))
