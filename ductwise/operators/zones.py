"""Segments against areas with holes: stretches inside, merged stretches over many areas, distances to walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.functions import geometry as geo
from ductwise.operators import grid, network

SEGMENT = ("ax", "ay", "bx", "by")


def _extent(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"_x0": F.array_min(x), "_x1": F.array_max(x), "_y0": F.array_min(y), "_y1": F.array_max(y)}


def pairs(segments: DataFrame, areas: DataFrame, rings: str = "rings", reach: Column | float = 0.0, size: float = 50.0) -> DataFrame:
    """Segments (ax, ay, bx, by) with the areas whose extent, widened by reach, theirs meets; each pair once, from the cell that holds the lower corner of what they share. No column names may be in both."""
    s = segments.withColumns({"_sx0": F.least("ax", "bx"), "_sy0": F.least("ay", "by"), "_sx1": F.greatest("ax", "bx"), "_sy1": F.greatest("ay", "by")})
    wide = F.lit(reach) if isinstance(reach, (int, float)) else reach
    r = areas.withColumns(_extent(F.col(rings))).withColumns({f"_{c}{n}": F.col(f"_{c}{n}") + (wide if n else -wide) for c in "xy" for n in (0, 1)})
    a = grid.over_cells(s, F.col("_sx0"), F.col("_sy0"), F.col("_sx1"), F.col("_sy1"), size)
    b = grid.over_cells(r, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), size)
    meet = (F.col("_sx0") <= F.col("_x1")) & (F.col("_x0") <= F.col("_sx1")) & (F.col("_sy0") <= F.col("_y1")) & (F.col("_y0") <= F.col("_sy1"))
    home = (F.col("_cx") == grid.cell(F.greatest("_sx0", "_x0"), size)) & (F.col("_cy") == grid.cell(F.greatest("_sy0", "_y0"), size))
    return a.join(b, ["_cx", "_cy"]).where(meet & home).select(*segments.columns, *areas.columns)


def _shapes(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*columns).distinct()


def inside(segments: DataFrame, areas: DataFrame, rings: str = "rings", size: float = 50.0, measures: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of segments and areas with `inside`, the stretches (low, high) of the segment in the area, where there are any.

    Equal segments and equal areas are cut once; so are `measures`, further columns by name that depend on `inside` only.
    """
    near = grid.spread(pairs(_shapes(segments, SEGMENT), _shapes(areas, (rings,)), rings, 0.0, size))
    found = clip.with_inside(near, SEGMENT, rings).where(F.size("inside") > 0)
    found = clip.kept(found, **measures) if measures else found
    rows = grid.spread(segments).join(areas.join(found, rings), list(SEGMENT))
    return rows.select(*segments.columns, *areas.columns, "inside", *(measures or {}))


def stretches(segments: DataFrame, areas: DataFrame, keys: list[str], position: str | None = None, rings: str = "rings", gap: float = 0.0, size: float = 50.0) -> DataFrame:
    """(*keys, low, high): the stretches of lines that lie in any of the areas, as lengths along the line, in one where they are no more than gap apart.

    A line is the segments of one key, each beginning `position` along it (None: at 0). Equal segments are cut once and have their
    stretches merged before they go to their lines; an area that is there twice adds nothing.
    """
    length = geo.distance(*[F.col(c).cast("double") for c in SEGMENT])
    merged = lambda rows, by: network.merge_intervals(rows.withColumn("_k", F.lit(1)), by, "low", "high", "_k", gap=gap).drop("_k")
    cut = inside(_shapes(segments, SEGMENT), _shapes(areas, (rings,)), rings, size).select(*SEGMENT, length.alias("_length"), F.explode("inside").alias("_s"))
    cut = merged(cut.select(*SEGMENT, (F.col("_s.low") * F.col("_length")).alias("low"), (F.col("_s.high") * F.col("_length")).alias("high")), list(SEGMENT))
    begin = F.col(position) if position else F.lit(0.0)
    lines = segments.select(*dict.fromkeys([*keys, *SEGMENT]), begin.alias("_begin"))
    rows = lines.join(cut, list(SEGMENT)).select(*keys, (F.col("_begin") + F.col("low")).alias("low"), (F.col("_begin") + F.col("high")).alias("high"))
    return merged(rows, keys)


def too_close(segments: DataFrame, areas: DataFrame, least: str, rings: str = "rings", tolerance: float = 0.01, size: float = 50.0) -> DataFrame:
    """Pairs of segments and areas with `distance`, where that is under the column `least` by more than the tolerance. In an area, or on its border, the distance is 0. Equal segments and equal areas are measured once."""
    near = grid.spread(pairs(_shapes(segments, SEGMENT), _shapes(areas, (rings, least)), rings, F.col(least).cast("double"), size))
    s = tuple(F.col(c).cast("double") for c in SEGMENT)
    rows = clip.kept(near, _e=clip.edges(F.col(rings)), _held=clip.in_rings(F.col(rings), s[0], s[1]))
    walls = F.transform("_e", lambda e: clip.segment_distance(s, (e.ax, e.ay, e.bx, e.by)))
    found = clip.kept(rows, distance=F.when(F.col("_held"), 0.0).otherwise(F.array_min(walls))).where(F.col("distance") < F.col(least) - tolerance)
    rows = segments.join(areas.join(found.select(*SEGMENT, rings, least, "distance"), [rings, least]), list(SEGMENT))
    return rows.select(*segments.columns, *areas.columns, "distance")
