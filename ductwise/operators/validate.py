"""Independent check of a result: each rule is a query over segments, chambers, consumers and summaries.

Tables (all with variant_id): segments (fid, start_node, end_node, flow, dn, length, price_k, cost, line as an array of x, y;
an edge runs from the consumer's side, start, to the network, end), chambers (fid, dn, cost), consumers (fid, flow), ties
(node: where new pipe meets the old network), summaries (rank, cost, length, penalty, total, score, unconnected as an array).
Findings are (rule, severity, variant_id, feature_id, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.functions import geometry as geo
from ductwise.functions import reference as ref
from ductwise.operators import components, grid, trees, zones
from ductwise.session import cut_lineage


def _found(rows: DataFrame, rule: str, message: Column | str, severity: str = "ERROR", feature: str = "fid") -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("variant_id").cast("long").alias("variant_id"), F.col(feature).cast("string").alias("feature_id"), said.alias("message"))


def repeated_ids(segments: DataFrame, chambers: DataFrame) -> DataFrame:
    ids = segments.select("variant_id", "fid").unionByName(chambers.select("variant_id", "fid"))
    return _found(ids.groupBy("variant_id", "fid").count().where("count > 1"), "OUT-ID", "id is used more than once")


def lengths(segments: DataFrame) -> DataFrame:
    return _found(segments.where(F.abs(geo.line_length(F.col("line")) - F.col("length")) > 0.05), "R-LEN", "length differs from the geometry")


def turns(segments: DataFrame) -> DataFrame:
    """Corners inside a segment over the limit and its tolerance."""
    rows = clip.kept(segments.select("variant_id", "fid", "line").where(F.size("line") > 2), _line=F.col("line")).drop("line")
    corner = lambda i: F.struct(*[F.get("_line", i + d)[c].alias(f"{c}{n}") for n, d in enumerate((-1, 0, 1)) for c in "xy"])
    rows = clip.kept(rows, _corners=F.transform(F.sequence(F.lit(1), F.size("_line") - 2), corner))
    angle = lambda q: geo.turn_degrees(*[q[f"{c}{n}"] for n in range(3) for c in "xy"])
    rows = clip.kept(rows, _sharp=F.exists(F.transform("_corners", angle), lambda a: a > ref.MAX_TURN + ref.TURN_TOLERANCE))
    return _found(rows.where("_sharp"), "R-TURN", "turns by more than the limit")


def one_parent(segments: DataFrame) -> DataFrame:
    """Every node has one way to the network at most, so the new part is a forest."""
    return _found(segments.groupBy("variant_id", "start_node").count().where("count > 1"), "R-NET-4", "more than one way to the network", feature="start_node")


def _edges(segments: DataFrame) -> DataFrame:
    """(variant_id, node, parent, ...) with nodes named by variant, so that one closure serves all variants."""
    name = lambda c: F.concat_ws("|", F.col("variant_id").cast("string"), F.col(c))
    return segments.withColumns({"node": name("start_node"), "parent": name("end_node")})


def reach(segments: DataFrame, ties: DataFrame) -> DataFrame:
    """Chains of new pipe that do not end in a tie-in, and those that never end."""
    name = F.concat_ws("|", F.col("variant_id").cast("string"), F.col("node"))
    ends = ties.select(name.alias("top"), F.lit(True).alias("tied")).distinct()
    rows = _edges(segments).join(trees.climb(_tree(segments)).select("node", "top", "cyclic"), "node").join(ends, "top", "left")
    lost = _found(rows.where("not cyclic and tied is null"), "R-NET-1", "does not lead to a tie-in")
    return lost.unionByName(_found(rows.where("cyclic"), "R-NET-4", "leads round in a ring"))


def _tree(segments: DataFrame, *values: str) -> DataFrame:
    """Edges and, as nodes without a parent, the ends that no segment starts from."""
    e = _edges(segments).select("node", "parent", *values)
    ends = e.select(F.col("parent").alias("node")).distinct().join(e.select("node"), "node", "left_anti")
    return e.unionByName(ends, allowMissingColumns=True)


def connected_parts(segments: DataFrame, ties: DataFrame) -> DataFrame:
    """Parts of the new network that are no trees, and those with no tie-in or more than one; a finding names the part's first segment."""
    e = _edges(segments).select(F.struct("variant_id", F.col("fid").cast("string").alias("fid")).alias("id"), F.col("node").alias("a"), F.col("parent").alias("b"))
    tied = ties.select(F.concat_ws("|", F.col("variant_id").cast("string"), F.col("node")).alias("node"))
    found = cut_lineage(components.parts(e, tied).select("first.variant_id", "first.fid", "edges", "nodes", "marks"))
    shape = F.concat(F.lit("part is not a tree: "), F.col("edges").cast("string"), F.lit(" segments, "), F.col("nodes").cast("string"), F.lit(" nodes"))
    no_tree = _found(found.where("edges <> nodes - 1"), "R-NET-4", shape)
    return no_tree.unionByName(_found(found.where("marks <> 1"), "R-NET-3", F.concat(F.lit("part has "), F.col("marks").cast("string"), F.lit(" tie-ins, 1 is required"))))


def ends_at_nodes(segments: DataFrame, nodes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Segments that name a node (variant_id, node, x, y) that is not there, or end away from it."""
    line = F.col("line")
    first, last = F.get(line, F.lit(0)), F.try_element_at(line, F.lit(-1))
    ends = F.array(F.struct(F.col("start_node").alias("node"), first.x.alias("ex"), first.y.alias("ey")), F.struct(F.col("end_node").alias("node"), last.x.alias("ex"), last.y.alias("ey")))
    rows = segments.select("variant_id", "fid", F.inline(ends)).join(nodes.select("variant_id", "node", "x", "y"), ["variant_id", "node"], "left")
    unknown = _found(rows.where("x is null"), "R-TOPO", F.concat(F.lit("unknown node "), F.coalesce(F.col("node").cast("string"), F.lit("null"))))
    off = geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))
    apart = F.coalesce(off > tolerance, F.lit(True))
    return unknown.unionByName(_found(rows.where(F.col("x").isNotNull() & apart), "R-TOPO", F.concat(F.lit("ends away from node "), F.col("node").cast("string"))))


def connected_or_listed(segments: DataFrame, consumers: DataFrame, summaries: DataFrame) -> DataFrame:
    listed = summaries.select("variant_id", F.explode("unconnected").alias("fid")).withColumn("listed", F.lit(True))
    joined = segments.select("variant_id", F.col("start_node").alias("fid")).distinct().withColumn("joined", F.lit(True))
    all_ = consumers.select("fid").crossJoin(F.broadcast(summaries.select("variant_id")))  # three variants at most
    rows = all_.join(listed, ["variant_id", "fid"], "left").join(joined, ["variant_id", "fid"], "left")
    return _found(rows.where(F.coalesce("listed", F.lit(False)) == F.coalesce("joined", F.lit(False))), "R-NET-1", "is neither connected nor listed, or both")


def flows(segments: DataFrame, consumers: DataFrame) -> DataFrame:
    """Flow of a segment against the sum of the consumers behind it. What leads round in a ring has no such sum and is a finding of `reach`."""
    own = consumers.select(F.col("fid").alias("start_node"), F.col("flow").alias("sum"))
    sums = trees.gather(_tree(segments.drop("sum").join(own, "start_node", "left"), "sum"), sums=["sum"]).select("node", "sum")
    rows = _edges(segments).join(sums, "node")
    return _found(rows.where(F.abs(F.col("flow") - F.col("sum")) > 1e-4 + 1e-6 * F.abs("sum")), "R-NET-8", F.concat(F.lit("flow should be "), F.round("sum", 3).cast("string")))


def _next_below(segments: DataFrame) -> DataFrame:
    """(variant_id, start_node, below_dn): the widest pipe that comes to the start of a segment from further out."""
    return segments.groupBy("variant_id", F.col("end_node").alias("start_node")).agg(F.max("dn").alias("below_dn"))


def diameters(segments: DataFrame) -> DataFrame:
    """Pipes too small for their flow, narrower than what feeds them, or wider than flow and length ask for."""
    need = ref.dn_for_flow(F.col("flow"))
    small = _found(segments.where(need.isNull() | (F.col("dn") < need)), "R-NET-9", "diameter is too small for the flow")
    up = segments.select("variant_id", F.col("start_node").alias("end_node"), F.col("dn").alias("next_dn"))
    narrowing = _found(segments.join(up, ["variant_id", "end_node"]).where("next_dn < dn"), "R-NET-9", "diameter falls towards the network")
    return small.unionByName(narrowing)


def longest_ways(segments: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """Segments with `way`: the longest stretch of the segment's diameter on any way from a consumer through it to the network.

    Without consumers (fid) every outer end is one. Branches side by side do not add up. Segments in a ring, or that no consumer is behind, have no row.
    """
    if consumers is not None:
        fed = consumers.select(F.col("fid").alias("start_node"), F.lit(1).alias("fed")).distinct()
        behind = trees.gather(_tree(segments.join(fed, "start_node", "left"), "fed"), maxes=["fed"]).where("fed = 1").select("node")
        used = _edges(segments).join(behind, "node", "left_semi").drop("node", "parent")
    else:
        used = segments
    edges = cut_lineage(_edges(used))
    ways = trees.runs_up(edges, "dn", ["length"]).select("node", F.col("longest_length").alias("way"))
    return edges.join(ways, "node").drop("node", "parent")


def run_lengths(segments: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """Pipe of one diameter on each way from a consumer to the network, against the longest allowed: every segment of a way that is too long."""
    rows = longest_ways(segments, consumers).where(F.col("way") > ref.max_run(F.col("dn")) + 0.05)
    return _found(rows, "R-NET-10", "pipe of one diameter is too long")


def oversized(segments: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """Warnings of pipes wider than their flow needs, where neither the longest run allowed for the smaller size nor a pipe further out that is as wide is a reason."""
    need = ref.dn_for_flow(F.col("flow"))
    rows = longest_ways(segments, consumers).select("variant_id", "fid", "way")
    rows = segments.join(rows, ["variant_id", "fid"], "left").join(_next_below(segments), ["variant_id", "start_node"], "left").withColumn("need", need)
    wide = (F.col("dn") > F.col("need")) & (F.coalesce("way", F.lit(0.0)) <= ref.max_run(F.col("need")) + 0.05) & ~F.coalesce(F.col("below_dn") >= F.col("dn"), F.lit(False))
    return _found(rows.where(wide), "R-NET-9", F.concat(F.lit("diameter is larger than needed: "), F.col("need").cast("string")), "WARNING")


def costs(segments: DataFrame) -> DataFrame:
    return _found(segments.where(F.abs(ref.segment_cost(F.col("length"), F.col("dn"), F.col("price_k")) - F.col("cost")) > 0.05), "R-COST", "cost differs from price by length")


def chamber_sizes(segments: DataFrame, chambers: DataFrame) -> DataFrame:
    """Diameter and cost of a new chamber by the largest pipe that meets in it; at most four pieces."""
    ends = segments.select("variant_id", "dn", F.explode(F.array("start_node", "end_node")).alias("fid"))
    most = ends.groupBy("variant_id", "fid").agg(F.max("dn").alias("most"), F.count("*").alias("degree"))
    rows = chambers.join(most, ["variant_id", "fid"], "left")
    sized = _found(rows.where(~F.col("dn").eqNullSafe(F.col("most")) | (F.col("cost") != ref.chamber_cost(F.col("dn")))), "R-TIE-3", "diameter or cost of the chamber")
    return sized.unionByName(_found(rows.where(F.col("degree") > ref.MAX_DEGREE), "R-NET-5", "too many pieces meet"))


def _steps(segments: DataFrame, *keys: str) -> DataFrame:
    """(variant_id, *keys, line, ax, ay, bx, by): the straight pieces of each segment's line; keys are fid if none are given."""
    p = lambda i, c: F.get("line", i)[c]
    keys = ("variant_id", *(keys or ["fid"]))
    steps = segments.where(F.size("line") > 1).select(*keys, "line", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("i"))
    return steps.select(*keys, "line", *[p(F.col("i") + d, c).alias(f"{n}{c}") for n, d in (("a", -1), ("b", 0)) for c in "xy"])


def crossings(segments: DataFrame, size: float = 50.0, tolerance: float = 0.05) -> DataFrame:
    """New pipes with a point in common, crossing, touching or one on the other, that is not an end of both.

    Pipes of a variant with the same line are one until they are named, so each pair of different lines is tested once.
    """
    members, shapes = grid.classes(segments.select("variant_id", "fid", "line"), "fid", ["line"], "variant_id")
    ends = F.transform(F.array(F.get("line", F.lit(0)), F.element_at("line", -1)), lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))
    steps = _steps(shapes, "class", "copies").withColumn("ends", ends).drop("line")
    steps = steps.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    pairs = grid.pairs_of_boxes(steps, "class", "x0", "y0", "x1", "y1", size, within="variant_id", equal=True)
    pairs = grid.spread(pairs.where("a.class <> b.class or a.copies > 1"))
    one, two = (tuple(F.col(f"{s}.{c}") for c in ("ax", "ay", "bx", "by")) for s in "ab")
    low, high, _ = clip.common_part(one, two)
    at = lambda t: ((one[0] + t * (one[2] - one[0])), (one[1] + t * (one[3] - one[1])))
    end_of = lambda s, t: F.exists(F.col(f"{s}.ends"), lambda q: geo.distance(q.x, q.y, *at(t)) <= tolerance)
    apart = lambda c: ~(end_of("a", F.col(c)) & end_of("b", F.col(c)))
    rows = clip.kept(pairs, low=low, high=high).where(F.col("low").isNotNull()).where(apart("low") | apart("high"))
    found = rows.select("a.variant_id", F.col("a.class").alias("_a"), F.col("b.class").alias("_b")).distinct()
    member = lambda side: grid.spread(members.select("variant_id", F.col("class").alias(f"_{side}"), F.col("fid").cast("string").alias(side)))
    named = grid.spread(found.join(member("a"), ["variant_id", "_a"])).join(member("b"), ["variant_id", "_b"]).where("_a <> _b or a < b")
    named = named.select("variant_id", F.least("a", "b").alias("fid"), F.greatest("a", "b").alias("other"))
    return _found(named, "R-NET-7", F.concat(F.lit("meets "), F.col("other"), F.lit(" outside a common end")))


def near_obstacles(segments: DataFrame, obstacles: DataFrame, reach: float = 20.0) -> DataFrame:
    """Steps of new pipe closer to the corners of a forbidden obstacle (fid, min_distance, x, y) than allowed."""
    steps = segments.select("variant_id", "fid", "line", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("i"))
    p = lambda i, c: F.get("line", i)[c]
    steps = steps.select("variant_id", "fid", *[p(F.col("i") + d, c).alias(f"{c}{n}") for n, d in (("a", -1), ("b", 0)) for c in "xy"])
    boxes = steps.withColumns({"x0": F.least("xa", "xb") - reach, "y0": F.least("ya", "yb") - reach, "x1": F.greatest("xa", "xb") + reach, "y1": F.greatest("ya", "yb") + reach})
    pairs = grid.points_in_boxes(obstacles.withColumnRenamed("fid", "obstacle"), boxes, "x", "y", "x0", "y0", "x1", "y1", 4 * reach)
    d = geo.point_segment_distance(F.col("x"), F.col("y"), F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    return _found(pairs.where(d < F.col("min_distance") - 0.01).select("variant_id", "fid", "obstacle").distinct(), "R-RESTR", F.concat(F.lit("too close to "), F.col("obstacle")))


def near_walls(segments: DataFrame, obstacles: DataFrame) -> DataFrame:
    """New pipe closer to the walls of a forbidden obstacle (fid, min_distance, rings) than allowed, or inside it; holes are outside."""
    areas = obstacles.select(F.col("fid").alias("obstacle"), "min_distance", "rings")
    rows = zones.too_close(_steps(segments).drop("line"), areas, "min_distance").select("variant_id", "fid", "obstacle").distinct()
    return _found(rows, "R-RESTR", F.concat(F.lit("too close to "), F.col("obstacle").cast("string")))


def near_walls_summary(segments: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(feature_id, n, first): how many findings of `near_walls` a segment has over all variants, and the first message, without naming every pair: segments of one line meet obstacles of one shape once."""
    members, shapes = grid.classes(segments.select("variant_id", "fid", "line"), "fid", ["line"], "variant_id")
    walled, walls = grid.classes(obstacles.select(F.col("fid").alias("obstacle"), "min_distance", "rings"), "obstacle", ["min_distance", "rings"])
    said = F.concat(F.lit("too close to "), F.col("obstacle").cast("string"))
    groups = walled.groupBy(F.col("class").alias("wall")).agg(F.count("*").alias("n"), F.min(said).alias("first"))
    near = zones.too_close(_steps(shapes, "class").drop("line"), walls.select(F.col("class").alias("wall"), "min_distance", "rings"), "min_distance")
    sums = near.select("variant_id", "class", "wall").distinct().join(groups, "wall").groupBy("variant_id", "class").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return members.join(sums, ["variant_id", "class"]).groupBy(F.col("fid").cast("string").alias("feature_id")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def totals(segments: DataFrame, chambers: DataFrame, summaries: DataFrame, consumers: DataFrame) -> DataFrame:
    s = segments.groupBy("variant_id").agg(F.sum("cost").alias("pipe_sum"), F.sum("length").alias("length_sum"), F.count("*").alias("n"))
    c = chambers.groupBy("variant_id").agg(F.sum("cost").alias("chamber_sum"))
    lost = summaries.select("variant_id", F.explode("unconnected").alias("fid")).join(consumers, "fid").groupBy("variant_id").agg(F.sum(ref.penalty(F.col("flow"))).alias("penalty_sum"))
    rows = reduce(lambda a, b: a.join(b, "variant_id", "left"), (s, c, lost), summaries).na.fill(0, ["pipe_sum", "length_sum", "n", "chamber_sum", "penalty_sum"])
    off = lambda a, b: F.abs(F.col(a) - b) > 0.05 * F.col("n") + 1e-7 * F.abs(b) + 1e-6
    wrong = off("cost", F.col("pipe_sum") + F.col("chamber_sum")) | off("length", F.col("length_sum")) | off("penalty", F.col("penalty_sum")) | off("total", F.col("cost") + F.col("penalty"))
    sums = _found(rows.where(wrong), "R-SUM", "totals differ from the parts", feature="variant_id")
    scored = F.abs(F.col("score") - ref.score(F.col("total"), F.col("length"))) > 1e-5
    return sums.unionByName(_found(rows.where(scored), "R-SCORE", "score differs from its formula", feature="variant_id"))


def ranks(summaries: DataFrame) -> DataFrame:
    right = F.row_number().over(W.orderBy("score", "variant_id"))  # three variants at most
    return _found(summaries.withColumn("right", right).where("rank <> right"), "R-RANK", "rank is not the place by score", feature="variant_id")


def findings(segments: DataFrame, chambers: DataFrame, consumers: DataFrame, ties: DataFrame, summaries: DataFrame, obstacles: DataFrame | None = None) -> DataFrame:
    """All rules together; no rows for a good result. Obstacles (fid, min_distance, rings) are those that no pipe may come near."""
    parts = [repeated_ids(segments, chambers), lengths(segments), turns(segments), one_parent(segments), reach(segments, ties), connected_or_listed(segments, consumers, summaries), flows(segments, consumers), diameters(segments), run_lengths(segments, consumers), oversized(segments, consumers), costs(segments), chamber_sizes(segments, chambers), crossings(segments), totals(segments, chambers, summaries, consumers), ranks(summaries)]
    parts += [near_walls(segments, obstacles)] if obstacles is not None else []
    return reduce(lambda a, b: a.unionByName(b), parts)
