"""Separate connection: every consumer by the straight way to the nearest point of the existing network.

The plan is relational: nearest segment by grid cells, diameter by flow, cost and score by the reference tables. Ways around
obstacles, and joint branches, are not searched for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo
from ductwise.functions import reference as ref
from ductwise.operators import grid
from ductwise.session import cut_lineage


def nearest_tie(consumers: DataFrame, network: DataFrame, size: float = 100.0, rounds: int = 16) -> DataFrame:
    """(fid, segment, x, y, tx, ty, distance): foot of each consumer (fid, x, y) on the nearest segment (fid, ax, ay, bx, by).

    Looks in a square around each consumer and doubles it for those without a segment within its half side.
    """
    todo, found = consumers.select("fid", "x", "y"), None
    lines = network.select(F.col("fid").alias("segment"), "ax", "ay", "bx", "by")
    if lines.isEmpty():
        return todo.select("fid", F.lit(None).cast("string").alias("segment"), "x", "y", *[F.lit(0.0).alias(c) for c in ("tx", "ty", "distance")]).limit(0)
    for _ in range(rounds):
        boxes = lines.withColumns({"x0": F.least("ax", "bx") - size, "y0": F.least("ay", "by") - size, "x1": F.greatest("ax", "bx") + size, "y1": F.greatest("ay", "by") + size})
        near = grid.points_in_boxes(todo, boxes, "x", "y", "x0", "y0", "x1", "y1", 2 * size)
        t = geo.place_on_segment(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
        near = near.withColumns({"tx": F.col("ax") + t * (F.col("bx") - F.col("ax")), "ty": F.col("ay") + t * (F.col("by") - F.col("ay"))})
        near = near.withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))).where(F.col("distance") <= size)
        best = near.groupBy("fid").agg(F.min(F.struct("distance", "segment", "x", "y", "tx", "ty")).alias("b"))
        best = cut_lineage(best.select("fid", "b.segment", "b.x", "b.y", "b.tx", "b.ty", "b.distance"))
        found = best if found is None else found.unionByName(best)
        todo = cut_lineage(todo.join(best.select("fid"), "fid", "left_anti"))
        if todo.isEmpty():
            return found
        size *= 2
    return found


def separate_variant(consumers: DataFrame, network: DataFrame, variant_id: int = 1) -> dict[str, DataFrame]:
    """Segments, ties, chambers and summary of the plan, in the tables that `validate.findings` reads."""
    ways = nearest_tie(consumers, network).join(consumers.select("fid", "flow"), "fid").withColumn("dn", ref.dn_for_flow(F.col("flow")))
    fits = ways.where(F.col("dn").isNotNull() & (F.col("distance") <= ref.max_run(F.col("dn"))))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    length = ref.round_half_up(F.col("distance"), 3)
    segments = fits.select(F.lit(variant_id).alias("variant_id"), F.concat(F.lit("new-"), "fid").alias("fid"), F.col("fid").alias("start_node"), F.concat(F.lit("tie-"), "fid").alias("end_node"), "flow", "dn", length.alias("length"), F.lit(1.0).alias("price_k"), ref.segment_cost(length, F.col("dn"), F.lit(1.0)).alias("cost"), F.array(point("x", "y"), point("tx", "ty")).alias("line"))
    segments = cut_lineage(segments)
    chambers = segments.select("variant_id", F.col("end_node").alias("fid"), "dn", ref.chamber_cost(F.col("dn")).alias("cost"))
    lost = consumers.join(segments.select(F.col("start_node").alias("fid")), "fid", "left_anti")
    sums = segments.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("pipes"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    fees = lost.agg(F.coalesce(F.sum(ref.penalty(F.col("flow"))), F.lit(0.0)).alias("penalty"), F.sort_array(F.collect_list("fid")).alias("unconnected"))
    built = chambers.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("chambers"))
    one = sums.crossJoin(fees).crossJoin(built)  # a row each
    total = F.col("pipes") + F.col("chambers") + F.col("penalty")
    summary = one.select(F.lit(variant_id).alias("variant_id"), F.lit(1).alias("rank"), (F.col("pipes") + F.col("chambers")).alias("cost"), "length", "penalty", total.alias("total"), ref.score(total, F.col("length")).alias("score"), "unconnected")
    return {"segments": segments, "chambers": chambers, "ties": segments.select("variant_id", F.col("end_node").alias("node")), "summaries": cut_lineage(summary)}
