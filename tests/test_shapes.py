import numpy as np
import pytest
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo
from ductwise.operators import shapes

LINE = "array<struct<x double, y double>>"


def test_hull_of_hulls(spark):
    rng = np.random.default_rng(1)
    pts = [("a", float(x), float(y)) for x, y in rng.integers(0, 100, (500, 2))] + [("b", 1.0, 1.0), ("b", 2.0, 2.0)]
    got = {r["k"]: r["hull"] for r in shapes.convex_hulls(spark.createDataFrame(pts, "k string, x double, y double"), "k", parts=7).collect()}
    ring = [(p["x"], p["y"]) for p in got["a"]]
    assert ring[0] == ring[-1] and got["b"] == []
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for k, x, y in pts if k == "a")


def test_simplify(spark):
    rows = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0)],), ([(0.0, 0.0), (1.0, 1.0)],), (None,)], f"line {LINE}")
    got = [None if r["line"] is None else [p["x"] for p in r["line"]] for r in shapes.simplify(rows, "line", 0.3).collect()]
    assert got == [[0, 2, 3, 4], [0, 1], None]


def test_self_crossing_and_corners(spark):
    bow = [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]
    notch = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]]
    rows = spark.createDataFrame([("bow", bow), ("notch", notch)], f"fid string, parts array<{LINE}>")
    assert [r["fid"] for r in shapes.self_crossing(rows, size=2.0).collect()] == ["bow"]
    got = shapes.convex_corners(rows.where("fid = 'notch'").select("fid", F.col("parts")[0].alias("ring")), "fid", "ring").collect()
    assert sorted(r["i"] for r in got) == [0, 1, 2, 4]


def test_exits_and_tiles(spark):
    ring = [[(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    rings = spark.createDataFrame([("b", ring)], f"fid string, parts array<{LINE}>")
    got = shapes.exits(spark.createDataFrame([("b", 3.0, 1.0)], "fid string, x double, y double"), rings).orderBy("rank").collect()
    assert [(r["ex"], r["ey"], r["distance"]) for r in got] == [(3, 0, 1), (3, 4, 3), (0, 1, 3)]
    t = shapes.in_tile(spark.createDataFrame([(37.6, 55.75)], "lon double, lat double"), 10).first()
    assert (t["tile_x"], t["tile_y"]) == (618, 320) and 0 <= t["px"] < 4096
    assert t["px"] == pytest.approx(((37.6 + 180) / 360 * 1024 - 618) * 4096, abs=1)


def test_areas_have_holes_and_segments_touch(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    rings = [[square(0.0, 10.0), square(2.0, 4.0)], [square(20.0, 23.0)]]
    row = spark.createDataFrame([(rings,)], "p array<array<array<struct<x double, y double>>>>").select(geo.area_of(F.col("p")).alias("a")).first()
    assert row["a"] == 100 - 4 + 9
    cases = [((0, 0, 4, 0), (2, 0, 2, 3), True), ((0, 0, 4, 0), (1, 0, 3, 0), True), ((0, 0, 4, 0), (5, 0, 6, 0), False), ((0, 0, 4, 4), (0, 4, 4, 0), True), ((0, 0, 4, 0), (0, 1, 4, 1), False), ((0, 0, 4, 0), (4, 0, 8, 5), True)]
    for a, b, want in cases:
        s = tuple(F.lit(x) for x in a), tuple(F.lit(x) for x in b)
        assert spark.range(1).select(geo.segments_meet(*s)).first()[0] is want


def test_walk_from_the_source_over_loops(spark):
    from ductwise.operators import network

    segments = [(1, 0, 1), (2, 2, 1), (3, 2, 0), (4, 3, 2), (5, 9, 8)]
    rows = network.derive_upstream(spark.createDataFrame(segments, "id long, a long, b long"), 0, -1).collect()
    assert sorted(map(tuple, rows)) == [(1, -1, 1), (2, 1, 2), (3, -1, 1), (4, 3, 2)]
