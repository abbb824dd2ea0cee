"""Pieces of a network merged into lines: maximal chains through nodes where just two ends meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.operators import components, trees
from ductwise.session import cut_lineage


def merged(pieces: DataFrame) -> DataFrame:
    """(id, line, position, forward, at, pieces, ring) of every piece (id, a, b, length): which line it is part of, its place in it from 0, whether it is drawn the way
    the line runs, the length before it, and how many pieces the line has.

    A line ends at nodes where one end meets, or more than two. It is named by the piece at its start, the end of smaller id. Where pieces close
    a ring, ring is true, line the smallest id, and position, forward and at are null. Ids are different whole numbers; a piece with a null end is
    none, a null length counts as nothing. Each piece points at the one that follows it in either direction, so a line of n pieces takes log n rounds.
    """
    rows = cut_lineage(pieces.where("id is not null and a is not null and b is not null").select(F.col("id").cast("long").alias("id"), "a", "b", F.coalesce("length", F.lit(0.0)).cast("double").alias("length")))
    end = lambda c, e: F.struct(F.col(c).alias("node"), F.col("id"), F.lit(e).cast("long").alias("e"), F.col("length"))
    ends = rows.select(F.inline(F.array(end("a", 0), end("b", 1))))
    one = F.struct("id", "e", "length")
    joints = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(one).alias("p"), F.max(one).alias("q")).where("n = 2")
    # leaving a piece by its end e goes on into the other piece by the end there: going from a to b is way 0
    step = lambda p, q: F.struct((F.col(f"{p}.id") * 2 + 1 - F.col(f"{p}.e")).alias("node"), (F.col(f"{q}.id") * 2 + F.col(f"{q}.e")).alias("parent"), F.col(f"{q}.length").alias("after"))
    joints = cut_lineage(joints.select("p", "q"))
    steps = joints.select(F.inline(F.array(step("p", "q"), step("q", "p"))))
    ways = rows.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("node"))
    found = trees.climb(ways.join(steps, "node", "left"), ["after"])
    way = lambda c, d: F.max(F.when(F.col("node") % 2 == d, F.col(c))).alias(f"{c}{d}")
    both = found.groupBy(F.floor(F.col("node") / 2).alias("id")).agg(*[way(c, d) for c in ("top", "depth", "after") for d in (0, 1)], F.max("cyclic").alias("ring"))
    both = cut_lineage(both)
    ahead = F.col("top1") < F.col("top0")  # going back ends at the start of the line
    lines = both.where("not ring").select("id", F.floor(F.least("top0", "top1") / 2).alias("line"), F.when(ahead, F.col("depth1")).otherwise(F.col("depth0")).alias("position"), ahead.alias("forward"), F.when(ahead, F.col("after1")).otherwise(F.col("after0")).alias("at"), (F.col("depth0") + F.col("depth1") + 1).alias("pieces"), "ring")
    rings = both.where("ring").select("id")
    roots = components.components(joints.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))).withColumnRenamed("node", "id")
    named = cut_lineage(rings.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("line")))
    sizes = named.groupBy("line").agg(F.count("*").alias("pieces"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("position", "long"), ("forward", "boolean"), ("at", "double"))]
    return lines.unionByName(named.join(sizes, "line").select("id", "line", *none, "pieces", F.lit(True).alias("ring")))


def merged_lines(pieces: DataFrame) -> DataFrame:
    """(line, pieces, length, ring): one row for each merged line."""
    lengths = pieces.select("id", F.coalesce("length", F.lit(0.0)).cast("double").alias("_l"))
    return merged(pieces).join(lengths, "id").groupBy("line", "pieces", "ring").agg(F.sum("_l").alias("length")).select("line", "pieces", "length", "ring")
