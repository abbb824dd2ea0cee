"""Nodes, ways and chambers of a network that comes as bare lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo
from ductwise.operators import components, grid, network
from ductwise.session import cut_lineage

# Fixed values of the domain: ends no further apart are one node; a chamber or the source belongs to a node no further away.
SNAP, GAP = 0.5, 2.0


def _cells(x: str, y: str, size: float) -> dict[str, Column]:
    return {"_cx": grid.cell(F.col(x), size), "_cy": grid.cell(F.col(y), size)}


def _around(df: DataFrame) -> DataFrame:
    """A row for each of the 25 cells within two steps of a row's cell; _ox, _oy keep its own."""
    rows = df.withColumnsRenamed({"_cx": "_ox", "_cy": "_oy"})
    return rows.withColumn("_cx", F.explode(F.sequence(F.col("_ox") - 2, F.col("_ox") + 2))).withColumn("_cy", F.explode(F.sequence(F.col("_oy") - 2, F.col("_oy") + 2)))


def first_come(points: DataFrame, radius: float = SNAP) -> DataFrame:
    """(seq, x, y) of the points that become nodes if each in order of seq becomes one unless a node of an earlier seq is within the radius.

    Points with a null seq or place are none. In rounds: a point is settled as a node once no earlier unsettled point can be within the radius, and settles all
    points around it. Of a cell half a radius wide only the first unsettled point can be next, and a cell holds one node at most, so no round
    pairs up the points of a crowded place. There are as many rounds as the longest row of points that wait for one another; points away from
    others are done in the first.
    """
    size = radius / 2
    todo = cut_lineage(points.where("seq is not null and x is not null and y is not null").select("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns(_cells("x", "y", size)))
    nodes = None
    while not todo.isEmpty():
        first = todo.groupBy("_cx", "_cy").agg(F.min(F.struct("seq", "x", "y")).alias("f"), F.count("*").alias("n"))
        first = cut_lineage(first.select("_cx", "_cy", "f.seq", "f.x", "f.y", "n"))
        other = _around(first).select("_cx", "_cy", F.struct(F.col("seq"), F.col("x"), F.col("y"), F.col("n"), F.col("_ox").alias("cx"), F.col("_oy").alias("cy")).alias("o"))
        gap = lambda p, c: F.greatest(F.lit(0.0), F.col(f"o.{c}") * size - F.col(p), F.col(p) - (F.col(f"o.{c}") + 1) * size)
        near = geo.distance(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y")) <= radius
        maybe = (F.col("o.n") > 1) & (gap("x", "cx") * gap("x", "cx") + gap("y", "cy") * gap("y", "cy") <= radius * radius)
        waits = F.max((F.col("o.seq") < F.col("seq")) & (near | maybe))
        fresh = first.join(other, ["_cx", "_cy"]).groupBy("_cx", "_cy", "seq", "x", "y").agg(waits.alias("w")).where("not w").drop("w")
        fresh = cut_lineage(fresh)
        reach = _around(fresh).select("_cx", "_cy", F.struct("x", "y").alias("f"))
        held = todo.join(reach, ["_cx", "_cy"], "left").withColumn("in", F.coalesce(geo.distance(F.col("x"), F.col("y"), F.col("f.x"), F.col("f.y")) <= radius, F.lit(False)))
        todo = cut_lineage(held.groupBy("seq", "x", "y", "_cx", "_cy").agg(F.max("in").alias("in")).where("not in").drop("in"))
        nodes = fresh if nodes is None else nodes.unionByName(fresh)
    found = todo if nodes is None else nodes
    return found.select("seq", "x", "y")


def snapped(points: DataFrame, radius: float = SNAP) -> DataFrame:
    """(seq, node): for each point the nearest node that was there when it came, itself if it became one; node is the seq of the point that made it. Ties go to the smaller."""
    nodes = cut_lineage(first_come(points, radius))
    spread = _around(nodes.withColumns(_cells("x", "y", radius / 2))).select("_cx", "_cy", F.struct("seq", "x", "y").alias("o"))
    rows = points.select("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns(_cells("x", "y", radius / 2))
    far = geo.distance(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y"))
    near = rows.join(spread, ["_cx", "_cy"]).withColumn("d", far).where((F.col("d") <= radius) & (F.col("o.seq") <= F.col("seq")))
    return near.groupBy("seq").agg(F.min(F.struct("d", "o.seq")).alias("b")).select("seq", F.col("b.seq").alias("node"))


def end_nodes(segments: DataFrame, radius: float = SNAP) -> tuple[DataFrame, DataFrame]:
    """(id, a, b) and (node, x, y): the nodes at both ends of segments (id, sx, sy, ex, ey); ids are whole numbers and give the order, the start before the end."""
    ends = [F.struct((F.col("id") * 2 + i).alias("seq"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for i, p in enumerate("se")]
    points = cut_lineage(segments.select(F.inline(F.array(*ends))))
    at = cut_lineage(snapped(points, radius))
    own = at.groupBy(F.floor(F.col("seq") / 2).alias("id")).agg(*[F.max(F.when(F.col("seq") % 2 == i, F.col("node"))).alias(c) for i, c in enumerate("ab")])
    return own.where("a is not null and b is not null"), points.join(at.select(F.col("node").alias("seq")).distinct(), "seq").select(F.col("seq").alias("node"), "x", "y")


def at_nodes(things: DataFrame, nodes: DataFrame, gap: float = GAP) -> DataFrame:
    """(id, node) of the things (id, x, y) that have a node within the gap: the nearest, ties to the smaller."""
    near = grid.within_radius(things.select("id", "x", "y"), nodes.select("node", F.col("x").alias("_nx"), F.col("y").alias("_ny")), "x", "y", "_nx", "_ny", gap)
    return near.groupBy("id").agg(F.min(F.struct("d2", "node")).alias("b")).select("id", F.col("b.node").alias("node"))


def derive(segments: DataFrame, chambers: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, upstream, upstream_kind) of segments and chambers, seen from the source, and (id, code) of what is wrong.

    Kinds are `segment`, `chamber` and `source`. What hangs at a node with a chamber hangs on the chamber, and that on the way into the node; of several
    chambers at a node the one of least id takes part and the others hang on the same way. The source, one row (id, x, y), is the root at its node
    within the gap, else at the nearest node (`network.source_not_on_network`). Segments that the source does not reach have no row (`network.detached_part`).
    No segments or no source give no rows. Of several ways into a node in one step of the walk the segment of least id counts.
    """
    spark = segments.sparkSession
    empty = spark.createDataFrame([], "id long, kind string, upstream long, upstream_kind string"), spark.createDataFrame([], "id long, code string")
    links, nodes = (cut_lineage(x) for x in end_nodes(segments))
    begin = source.select("id", "x", "y").first()
    if begin is None or nodes.isEmpty():
        return empty
    at = at_nodes(source, nodes).first()
    off = at is None
    if off:
        far = geo.distance(F.col("x"), F.col("y"), F.lit(float(begin["x"])), F.lit(float(begin["y"])))
        at = nodes.agg(F.min(F.struct(far.alias("d"), "node")).alias("b")).select("b.node").first()
    root = at["node"]
    walk = cut_lineage(network.derive_upstream(links, root, -1))
    ends = walk.join(links, "id").select("id", "upstream", "a", "b")
    above = links.select(F.col("id").alias("upstream"), F.array("a", "b").alias("_u"))
    through = F.when(F.col("upstream") == -1, F.lit(root)).when(F.array_contains("_u", F.col("a")), F.col("a")).otherwise(F.col("b"))
    entered = cut_lineage(ends.join(above, "upstream", "left").select("id", "upstream", through.alias("node")))
    into = entered.groupBy("node").agg(F.min("upstream").alias("into"))
    dead_ends = ends.select(F.explode(F.array("a", "b")).alias("node"), "id").groupBy("node").agg(F.min("id").alias("into")).join(into.select("node"), "node", "left_anti")
    into = into.unionByName(dead_ends)
    placed = at_nodes(chambers, nodes)
    holds = placed.groupBy("node").agg(F.min("id").alias("chamber"))
    named = lambda c: (F.when(c == -1, F.lit(begin["id"])).otherwise(c).cast("long").alias("upstream"), F.when(c == -1, "source").otherwise("segment").alias("upstream_kind"))
    hung = entered.join(holds, "node", "left")
    up, kind = named(F.col("upstream"))
    own = hung.select(F.col("id").cast("long").alias("id"), F.lit("segment").alias("kind"), F.coalesce("chamber", up).cast("long").alias("upstream"), F.when(F.col("chamber").isNotNull(), "chamber").otherwise(kind).alias("upstream_kind"))
    rooms = placed.join(into, "node").select(F.col("id").cast("long").alias("id"), F.lit("chamber").alias("kind"), *named(F.col("into")))
    wrong = links.join(walk, "id", "left_anti").select(F.col("id").cast("long").alias("id"), F.lit("network.detached_part").alias("code"))
    if off:
        wrong = wrong.unionByName(spark.range(1).select(F.lit(begin["id"]).cast("long").alias("id"), F.lit("network.source_not_on_network").alias("code")))
    return own.unionByName(rooms), wrong


def detached(segments: DataFrame, source: DataFrame) -> DataFrame:
    """(root, segments, first) of the connected parts of segments (id, sx, sy, ex, ey) that have no end within the gap of a source (id, x, y): the part's smallest node, how many segments it has, and the least id."""
    links, nodes = (cut_lineage(x) for x in end_nodes(segments))
    marks = at_nodes(source, nodes).select("node")
    found = components.parts(links, marks).where("marks = 0")
    return found.select("root", F.col("edges").alias("segments"), "first")
