"""Union, noding and difference of line networks: stretches of segments as intervals of a parameter from 0 to 1.

A network is a table of segments (id, ax, ay, bx, by), ids different within a group; the `within` column names the group (a variant, a run) if several are in one table.
Segments meet by grid cells, equal segments are one before they do, and all that follows is sums and windows over
the stretches of one segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.functions import geometry as geo
from ductwise.operators import grid

XY = ("ax", "ay", "bx", "by")
BOX = {"x0": F.least, "y0": F.least, "x1": F.greatest, "y1": F.greatest}


def _boxes(df: DataFrame, reach: float = 0.0) -> DataFrame:
    ends = {"x0": ("ax", "bx", -reach), "y0": ("ay", "by", -reach), "x1": ("ax", "bx", reach), "y1": ("ay", "by", reach)}
    return df.withColumns({f"_{c}": BOX[c](F.col(p), F.col(q)) + F.lit(r) for c, (p, q, r) in ends.items()})


def _keys(within: str | None) -> list[str]:
    return [within, "id"] if within else ["id"]


def once(segments: DataFrame, within: str | None = None) -> DataFrame:
    """(within, id, ax, ay, bx, by): segments of equal ends, either way round, are the one of least id; those without length or with a null end are none."""
    swap = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    low = [F.when(swap, F.col(q)).otherwise(F.col(p)).cast("double").alias(p) for p, q in zip(XY, ("bx", "by", "ax", "ay"), strict=True)]
    rows = segments.where("ax <> bx or ay <> by").where(" and ".join(f"{c} is not null" for c in XY))
    return rows.select(*_keys(within), *low).groupBy(*_keys(within)[:-1], *XY).agg(F.min("id").alias("id")).select(*_keys(within), *XY)


def covered(base: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, low, high, covered): the stretches of base, cut wherever any interval (*keys, low, high) of either begins or ends; covered tells whether one of cover holds the piece.

    Intervals may overlap; empty ones count as cuts only. One window over what lies on one key.
    """
    ends = lambda df, b, c: df.select(*keys, F.explode(F.array(*[F.struct(F.col(t).cast("double").alias("t"), F.lit(s * b).alias("b"), F.lit(s * c).alias("c")) for t, s in (("low", 1), ("high", -1))])).alias("e"))
    places = ends(base, 1, 0).unionByName(ends(cover, 0, 1)).groupBy(*keys, F.col("e.t").alias("low")).agg(F.sum("e.b").alias("b"), F.sum("e.c").alias("c"))
    w = W.partitionBy(*keys).orderBy("low")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    pieces = places.select(*keys, "low", F.lead("low").over(w).alias("high"), F.sum("b").over(so_far).alias("b"), (F.sum("c").over(so_far) > 0).alias("covered"))
    return pieces.where("b > 0 and high is not null").select(*keys, "low", "high", "covered")


def _whole(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.select(*keys, F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))


def _meetings(lines: DataFrame, size: float, within: str | None) -> DataFrame:
    """Rows (within, ida, idb, la, ha, lb, hb, along) of every pair of segments with a point in common, ida < idb, and where that lies on each."""
    group = [F.col(f"a.{within}").alias(within)] if within else []
    pairs = grid.pairs_of_boxes(_boxes(lines), "id", "_x0", "_y0", "_x1", "_y1", size, within)
    flat = pairs.select(*group, *[F.col(f"{s}.{c}").alias(f"{c}{s}") for s in "ab" for c in ("id", *XY)])
    a, b = (tuple(F.col(f"{c}{s}") for c in XY) for s in "ab")
    (la, ha, along), (lb, hb, _) = clip.common_part(a, b), clip.common_part(b, a)
    part = F.struct(la.alias("la"), ha.alias("ha"), lb.alias("lb"), hb.alias("hb"), along.alias("along"))
    # the filter works on a generated row: moved below, it would repeat the long expressions
    return flat.select(*_keys(within)[:-1], "ida", "idb", F.inline(F.filter(F.array(part), lambda p: p.la.isNotNull() & p.lb.isNotNull())))


def _piece(df: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches with the coordinates of their ends and their length."""
    at = lambda t, c: F.col(f"a{c}") + F.col(t) * (F.col(f"b{c}") - F.col(f"a{c}"))
    rows = df.join(lines.select(*keys, *XY), keys)
    rows = rows.withColumn("length", (F.col("high") - F.col("low")) * geo.distance(*[F.col(c) for c in XY]))
    return rows.select(*[c for c in df.columns], "length", *[at(t, c).alias(f"{p}{c}") for p, t in (("a", "low"), ("b", "high")) for c in "xy"])


def noded(segments: DataFrame, size: float, within: str | None = None, same: float = 1e-9) -> DataFrame:
    """(within, id, low, high, length, ax, ay, bx, by): the network cut wherever two segments cross, touch or begin to overlap; what several hold is there once, under the least id.

    Pieces shorter than `same` of their segment are none.
    """
    keys, lines = _keys(within), once(segments, within)
    met = _meetings(lines, size, within)
    part = lambda i, low, high: F.struct(F.col(f"id{i}").alias("id"), F.col(low).alias("low"), F.col(high).alias("high"))
    cuts = [part("a", "la", "la"), part("a", "ha", "ha"), part("b", "lb", "lb"), part("b", "hb", "hb"), F.when(F.col("along") & (F.col("hb") > F.col("lb")), part("b", "lb", "hb"))]
    places = met.select(*keys[:-1], F.inline(F.filter(F.array(*cuts), lambda p: p.isNotNull())))
    found = covered(_whole(lines, keys), places, keys)
    return _piece(found.where(~F.col("covered") & (F.col("high") - F.col("low") > same)).drop("covered"), lines, keys)


def union(segments: DataFrame, size: float, within: str | None = None) -> DataFrame:
    """(within, id, low, high, length, ax, ay, bx, by): each segment less what segments of smaller ids hold of it, so every place is there once."""
    keys, lines = _keys(within), once(segments, within)
    met = _meetings(lines, size, within).where("along and hb > lb")
    doubled = met.select(*keys[:-1], F.col("idb").alias("id"), F.col("lb").alias("low"), F.col("hb").alias("high"))
    return _piece(covered(_whole(lines, keys), doubled, keys).where("not covered").drop("covered"), lines, keys)


def with_near_part(df: DataFrame, s: clip.Ends, e: clip.Ends, reach: float) -> DataFrame:
    """Adds low, high: the parameters on s between which it is at most `reach` from e; null if it never is. Exact.

    What is near a segment is convex: two discs and a rectangle. So it cuts one stretch out of s, from the first entry into any of the
    three to the last way out. In steps of columns, as one expression for all would repeat its parts many times over.
    """
    c, r = F.col, float(reach)
    ends = dict(zip(("_ax", "_ay", "_bx", "_by", "_px", "_py", "_qx", "_qy"), [x.cast("double") for x in (*s, *e)], strict=True))
    rows = df.withColumns(ends).withColumns({"_dx": c("_bx") - c("_ax"), "_dy": c("_by") - c("_ay"), "_ux": c("_qx") - c("_px"), "_uy": c("_qy") - c("_py")})
    rows = rows.withColumns({"_l2": F.nullif(c("_dx") * c("_dx") + c("_dy") * c("_dy"), F.lit(0.0)), "_len": F.nullif(F.sqrt(c("_ux") * c("_ux") + c("_uy") * c("_uy")), F.lit(0.0))})
    mid = lambda p: ((c(f"_{p}x") - c("_ax")) * c("_dx") + (c(f"_{p}y") - c("_ay")) * c("_dy")) / c("_l2")
    turned = lambda x, y: ((x * c("_ux") + y * c("_uy")) / c("_len"), (y * c("_ux") - x * c("_uy")) / c("_len"))
    (at, across), (go, drift) = turned(c("_ax") - c("_px"), c("_ay") - c("_py")), turned(c("_dx"), c("_dy"))
    rows = rows.withColumns({"_mp": mid("p"), "_mq": mid("q"), "_at": at, "_across": across, "_go": go, "_drift": drift})
    off = lambda p: F.pow(c("_ax") + c(f"_m{p}") * c("_dx") - c(f"_{p}x"), 2) + F.pow(c("_ay") + c(f"_m{p}") * c("_dy") - c(f"_{p}y"), 2)
    half = lambda p: F.when(off(p) <= r * r, F.sqrt(F.greatest(F.lit(0.0), r * r - off(p)) / c("_l2")))
    bounds = {"_g": ("_at", "_go", F.lit(0.0), c("_len")), "_d": ("_across", "_drift", F.lit(-r), F.lit(r))}
    slabs = {}
    for name, (p, d, low, high) in bounds.items():
        still = F.abs(d) < 1e-15
        slabs[f"{name}0"] = F.when(still, F.when(c(p).between(low, high), -1e300)).otherwise((F.when(c(d) > 0, low).otherwise(high) - c(p)) / F.nullif(c(d), F.lit(0.0)))
        slabs[f"{name}1"] = F.when(still, F.when(c(p).between(low, high), 1e300)).otherwise((F.when(c(d) > 0, high).otherwise(low) - c(p)) / F.nullif(c(d), F.lit(0.0)))
    rows = rows.withColumns({"_hp": half("p"), "_hq": half("q"), **slabs})
    # greatest and least pass over nulls, so the rectangle counts only if both of its slabs are met
    box = c("_g0").isNotNull() & c("_d0").isNotNull()
    rows = rows.withColumns({"_b0": F.when(box, F.greatest("_g0", "_d0")), "_b1": F.when(box, F.least("_g1", "_d1"))})
    rows = rows.withColumn("_in", F.coalesce(c("_b0") <= c("_b1"), F.lit(False)))
    rows = rows.withColumns({"_low": F.least(c("_mp") - c("_hp"), c("_mq") - c("_hq"), F.when(c("_in"), c("_b0"))), "_high": F.greatest(c("_mp") + c("_hp"), c("_mq") + c("_hq"), F.when(c("_in"), c("_b1")))})
    some = (c("_low") <= 1) & (c("_high") >= 0)
    return rows.select(*df.columns, F.when(some, F.greatest(F.lit(0.0), c("_low"))).alias("low"), F.when(some, F.least(F.lit(1.0), c("_high"))).alias("high"))


def split_by_nearness(left: DataFrame, right: DataFrame, reach: float, size: float, within: str | None = None) -> DataFrame:
    """(within, id, low, high, covered, length, ax, ay, bx, by): the union of the left network in pieces that are at most `reach` from the right one (covered), and pieces that are not.

    Pieces also end where an interval of nearness to any one right segment does.
    """
    keys = _keys(within)
    lines, others = once(left, within), once(right, within)
    own = union(left, size, within).select(*keys, "low", "high")
    group = [within] if within else []
    cells = lambda df, r: grid.over_cells(_boxes(df, r), *[F.col(f"_{c}") for c in BOX], size)
    a = cells(lines, reach).select("_cx", "_cy", *group, F.struct("id", *XY, "_x0", "_y0", "_x1", "_y1").alias("a"))
    b = cells(others, 0.0).select("_cx", "_cy", *group, F.struct("id", *XY, "_x0", "_y0", "_x1", "_y1").alias("b"))
    meet = reduce(lambda x, y: x & y, [(F.col(f"a._{c}0") <= F.col(f"b._{c}1")) & (F.col(f"b._{c}0") <= F.col(f"a._{c}1")) for c in "xy"])
    home = reduce(lambda x, y: x & y, [F.col(f"_c{c}") == grid.cell(F.greatest(f"a._{c}0", f"b._{c}0"), size) for c in "xy"])
    pairs = a.join(b, ["_cx", "_cy", *group]).where(meet & home).select(*group, F.col("a.id").alias("id"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in XY])
    near = with_near_part(pairs, *[tuple(F.col(f"{s}_{c}") for c in XY) for s in "ab"], reach).select(*keys, "low", "high")
    near = near.select(*keys, F.inline(F.filter(F.array(F.struct("low", "high")), lambda p: p.low < p.high)))  # a filter would be moved below the steps and repeat them
    return _piece(covered(own, near, keys), lines, keys)


def compare_lengths(left: DataFrame, right: DataFrame, size: float, reach: float = 1.0, within: str | None = None) -> DataFrame:
    """(within, common, only_a, only_b): how much of the left network is at most `reach` from the right one, how much is not, and how much of the right one is away from the left. Nothing on a side gives 0."""
    group = [within] if within else []
    a, b = split_by_nearness(left, right, reach, size, within), split_by_nearness(right, left, reach, size, within)
    part = lambda df, c, a, b: df.select(*group, F.when(F.col("covered"), F.lit(c)).otherwise(F.lit(0)).alias("_c"), F.when(~F.col("covered"), F.lit(a)).otherwise(F.lit(0)).alias("_a"), F.when(~F.col("covered"), F.lit(b)).otherwise(F.lit(0)).alias("_b"), "length")
    rows = part(a, 1, 1, 0).unionByName(part(b, 0, 0, 1))
    total = lambda c, name: F.coalesce(F.sum(F.col(c) * F.col("length")), F.lit(0.0)).alias(name)
    return rows.groupBy(*group).agg(total("_c", "common"), total("_a", "only_a"), total("_b", "only_b"))
