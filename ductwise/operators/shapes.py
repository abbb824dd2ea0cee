"""Operators over whole shapes: hulls, simplification, self-crossings, corners, exits and tile coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.functions import geometry as geo
from ductwise.operators import grid


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, from the lowest left one against the clock; points on an edge are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def convex_hulls(points: DataFrame, key: str, x: str = "x", y: str = "y", parts: int = 32) -> DataFrame:
    """(key, hull): closed ring of (x, y) structs around the points of each key.

    A hull of hulls: first over salted parts of a key, so a key with very many points is spread, then over their corners. In
    the first step a task sees one part; its size falls with `parts`. Fewer than three corners give no ring.
    """
    kind = dict(points.dtypes)[key]

    def part(group: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(group[["x", "y"]].to_numpy(np.float64))
        return pd.DataFrame({key: group[key].iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(group[["x", "y"]].to_numpy(np.float64))
        ring = [{"x": a, "y": b} for a, b in [*h, h[0]]] if len(h) > 2 else []
        return pd.DataFrame({key: [group[key].iloc[0]], "hull": [ring]})

    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().distinct()
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    some = salted.groupBy(key, "_part").applyInPandas(part, f"`{key}` {kind}, x double, y double")
    return some.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, hull array<struct<x double, y double>>")


def _simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    keep, todo = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = line[b] - line[a], line[a + 1 : b] - line[a]
        norm = float(np.hypot(*d))
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / norm if norm else np.hypot(p[:, 0], p[:, 1])
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def simplify(df: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Lines of (x, y) structs with the vertices that lie within the tolerance of what is left taken out; ends stay."""

    @F.pandas_udf("array<struct<x double, y double>>")
    def run(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            return [{"x": a, "y": b} for a, b in _simplified(np.array([(p["x"], p["y"]) for p in line], np.float64), tolerance)]

        return lines.map(one)

    return df.withColumn(column, run(column))


def edges(features: DataFrame, key: str = "fid", parts: str = "parts") -> DataFrame:
    """(key, part, i, ax, ay, bx, by, x0, y0, x1, y1): the edges of all rings and lines with their envelopes."""
    lines = features.select(key, F.posexplode(parts).alias("part", "_line")).where(F.size("_line") > 1)
    out = lines.select(key, "part", "_line", F.explode(F.sequence(F.lit(1), F.size("_line") - 1)).alias("i"))
    at = lambda d, c: F.get("_line", F.col("i") - d)[c]
    out = out.select(key, "part", "i", at(1, "x").alias("ax"), at(1, "y").alias("ay"), at(0, "x").alias("bx"), at(0, "y").alias("by"))
    return out.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})


def self_crossing(features: DataFrame, key: str = "fid", size: float = 50.0) -> DataFrame:
    """Keys of shapes two of whose edges cross inside both."""
    e = edges(features, key).withColumn("_id", F.struct("part", "i"))
    pairs = grid.pairs_of_boxes(e, "_id", "x0", "y0", "x1", "y1", size, within=key)
    ends = lambda s: tuple(F.col(f"{s}.{c}") for c in ("ax", "ay", "bx", "by"))
    return pairs.where(geo.properly_cross(ends("a"), ends("b"))).select(F.col(f"a.{key}").alias(key)).distinct()


def convex_corners(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, i, x, y): corners of closed rings, drawn either way round, at which the outside is more than half a turn."""
    n = F.size(ring) - 1
    rows = rings.where(F.size(ring) > 3).select(key, F.col(ring).alias("_r"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    last = F.size("_r") - 1
    at = lambda k, c: F.get("_r", F.pmod(F.col("i") + k, last))[c]
    turn = geo.side(at(-1, "x"), at(-1, "y"), at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"))
    return rows.where(turn * geo.ring_sense(F.col("_r")) > 0).select(key, "i", at(0, "x").alias("x"), at(0, "y").alias("y"))


def exits(points: DataFrame, rings: DataFrame, key: str = "fid", k: int = 3, spacing: float = 0.5) -> DataFrame:
    """(key, rank, ex, ey, distance): ways straight out of a building (key, parts) from a point in it (key, x, y), the k shortest.

    A way ends at the foot of a perpendicular to a wall, the wall's ends included. From the nearest on, a foot counts if it is at least
    `spacing` from those before it that count, and its way stays inside the building, border and 5 cm included. The feet of one building are
    folded in order, so they meet in one row: as many as it has walls. No row where no way stays inside.
    """
    walls = edges(rings, key).join(points.select(key, "x", "y"), key)
    d2 = (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))
    t = ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.nullif(d2.cast("double"), F.lit(0.0))
    feet = walls.withColumn("_t", t).where(F.col("_t").between(0, 1))
    feet = feet.withColumns({"ex": F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax")), "ey": F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay"))})
    feet = feet.withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))).where("distance > 1e-9")
    shape = rings.select(key, F.col("parts").alias("_rings"))
    ways = clip.with_inside(feet.select(key, "part", "i", "x", "y", "ex", "ey", "distance").join(shape, key), ("x", "y", "ex", "ey"), "_rings")
    ways = ways.where((1 - clip.length_inside(F.col("inside"))) * F.col("distance") <= 0.05)
    rows = ways.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("distance", "part", "i", "ex", "ey"))).alias("_f"))
    apart = lambda kept, f: F.forall(kept, lambda o: geo.distance(o.ex, o.ey, f.ex, f.ey) >= spacing)
    kept = F.aggregate("_f", F.slice("_f", F.lit(1), F.lit(0)), lambda kept, f: F.when((F.size(kept) < k) & apart(kept, f), F.concat(kept, F.array(f))).otherwise(kept))
    return rows.select(key, F.posexplode(kept).alias("_r", "_e")).select(key, (F.col("_r") + 1).alias("rank"), "_e.ex", "_e.ey", "_e.distance")


def in_tile(points: DataFrame, zoom: int, extent: int = 4096) -> DataFrame:
    """Adds tile column and row, and the place inside the tile on a grid of `extent`, to points with lon and lat."""
    n = 2**zoom
    whole = geo.web_tile(F.col("lon"), F.col("lat"), zoom)
    fine = [c for c in geo.web_tile(F.col("lon"), F.col("lat"), zoom + extent.bit_length() - 1)]
    return points.withColumns({"tile_x": whole[0], "tile_y": whole[1], "px": fine[0] % extent, "py": fine[1] % extent}).where((F.col("tile_x") >= 0) & (F.col("tile_x") < n))
