import random

import pytest
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.operators import shapes, validate, zones

RINGS = "array<array<struct<x double, y double>>>"
U = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 3.0), (3.0, 3.0), (3.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (8.0, 1.0), (8.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]


def holds(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_stretches_as_sampled(spark):
    rng = random.Random(2)
    cases = [(i, *(rng.uniform(-2, 11) for _ in range(4))) for i in range(150)]
    rows = spark.createDataFrame([(*c, U) for c in cases], f"k int, ax double, ay double, bx double, by double, rings {RINGS}")
    got = {r["k"]: r for r in clip.with_hits(clip.with_inside(rows, zones.SEGMENT, "rings"), zones.SEGMENT, "rings").collect()}
    n = 4000
    for k, ax, ay, bx, by in cases:
        inside = [holds(U, ax + (bx - ax) * (i + 0.5) / n, ay + (by - ay) * (i + 0.5) / n) for i in range(n)]
        r = got[k]
        assert sum(s["high"] - s["low"] for s in r["inside"]) == pytest.approx(sum(inside) / n, abs=0.004)
        assert [h["t"] for h in r["hits"]] == sorted(h["t"] for h in r["hits"])
        for h in r["hits"]:
            assert abs(h["ex"]) + abs(h["ey"]) > 0
        turns = sum(a != b for a, b in zip(inside, inside[1:], strict=False))
        assert abs(len(r["hits"]) - turns) <= 2


def test_borders_corners_and_points(spark):
    cases = [
        ("along the outer wall", (0, 0, 9, 0), [(0, 1)]),
        ("through the hole", (4.5, -1, 4.5, 4), [(0.2, 0.4), (0.6, 0.8)]),
        ("along the hole's wall", (0, 1, 9, 1), [(0, 1)]),
        ("across the notch", (-1, 6, 10, 6), [(1 / 11, 4 / 11), (7 / 11, 10 / 11)]),
        ("touches a corner", (-1, 1, 1, -1), []),
        ("no length", (1, 0.5, 1, 0.5), []),
        ("outside", (20, 20, 30, 30), []),
        ("within", (0.2, 0.2, 8.8, 0.7), [(0, 1)]),
    ]
    rows = spark.createDataFrame([(name, *map(float, s), U) for name, s, _ in cases], f"k string, ax double, ay double, bx double, by double, rings {RINGS}")
    got = {r["k"]: [(s["low"], s["high"]) for s in r["inside"]] for r in clip.with_inside(rows, zones.SEGMENT, "rings").collect()}
    for name, _, want in cases:
        assert len(got[name]) == len(want), name
        assert [x for s in got[name] for x in s] == pytest.approx([x for s in want for x in s]), name


def test_merged_over_areas_along_a_line(spark):
    square = lambda x, w: [[(x, -1.0), (x + w, -1.0), (x + w, 1.0), (x, 1.0), (x, -1.0)]]
    areas = spark.createDataFrame([("a", square(1.0, 2.0)), ("b", square(2.5, 1.5)), ("c", square(4.1, 1.0)), ("d", square(12.0, 3.0))], f"area string, rings {RINGS}")
    line = spark.createDataFrame([("l", 0.0, 0.0, 0.0, 10.0, 0.0), ("l", 10.0, 10.0, 0.0, 20.0, 0.0)], "fid string, at double, ax double, ay double, bx double, by double")
    got = zones.stretches(line, areas, ["fid"], "at", gap=0.2, size=5.0).orderBy("low").collect()
    assert [x for r in got for x in (r["low"], r["high"])] == pytest.approx([1.0, 5.1, 12.0, 15.0])


LINE = "array<struct<x double, y double>>"
PIPE = f"variant_id long, fid string, line {LINE}"


def test_a_wall_far_from_its_corners_is_found(spark):
    wall = [[(-100.0, 4.0), (100.0, 4.0), (100.0, 30.0), (-100.0, 30.0), (-100.0, 4.0)]]
    yard = [[(-50.0, -50.0), (50.0, -50.0), (50.0, -20.0), (-50.0, -20.0), (-50.0, -50.0)], [(-10.0, -45.0), (10.0, -45.0), (10.0, -25.0), (-10.0, -25.0), (-10.0, -45.0)]]
    obstacles = spark.createDataFrame([("near", 5.0, wall), ("far", 3.0, wall), ("yard", 1.0, yard)], f"fid string, min_distance double, rings {RINGS}")
    pipes = [(1, "along", [(-3.0, 0.0), (3.0, 0.0)]), (1, "inside", [(-45.0, -40.0), (-40.0, -40.0)]), (1, "in the hole", [(-5.0, -35.0), (5.0, -35.0)])]
    got = {(r["feature_id"], r["message"]) for r in validate.near_walls(spark.createDataFrame(pipes, PIPE), obstacles).collect()}
    assert got == {("along", "too close to near"), ("inside", "too close to yard")}


def test_crossing_touching_and_lying_on(spark):
    pipe = [(0.0, 0.0), (10.0, 0.0)]
    others = {"crosses": [(5.0, -5.0), (5.0, 5.0)], "ends on it": [(3.0, 4.0), (3.0, 0.0)], "lies on it": [(6.0, 0.0), (12.0, 0.0)], "goes on": [(10.0, 0.0), (20.0, 0.0)], "turns off": [(0.0, 0.0), (0.0, 9.0)], "same": [(10.0, 0.0), (0.0, 0.0)], "bends on it": [(8.0, 5.0), (8.0, 0.0), (9.0, 5.0)]}
    for name, line in others.items():
        for order in ("az", "za"):
            rows = spark.createDataFrame([(1, order[0], pipe), (1, order[1], line), (2, "m", [(5.0, -1.0), (5.0, 1.0)])], PIPE)
            found = [r["feature_id"] for r in validate.crossings(rows).collect()]
            assert found == ([] if name in ("goes on", "turns off", "same") else ["a"]), name


def test_corners_of_rings_drawn_either_way(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    rows = spark.createDataFrame([("ccw", ring), ("cw", ring[::-1])], f"fid string, ring {LINE}")
    got = {}
    for r in shapes.convex_corners(rows, "fid", "ring").collect():
        got.setdefault(r["fid"], set()).add((r["x"], r["y"]))
    assert got["ccw"] == got["cw"] == set(ring[:-1]) - {(2.0, 1.0)}


def test_ways_out_of_an_l_shaped_building(spark):
    l = [[(0.0, 0.0), (10.0, 0.0), (10.0, 3.0), (3.0, 3.0), (3.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]  # noqa: E741
    rings = spark.createDataFrame([("b", l), ("c", l), ("empty", l)], f"fid string, parts {RINGS}")
    points = spark.createDataFrame([("b", 2.0, 8.0), ("c", 3.0, 1.0)], "fid string, x double, y double")
    got = {}
    for r in shapes.exits(points, rings, k=9).orderBy("fid", "rank").collect():
        got.setdefault(r["fid"], []).append((r["ex"], r["ey"], round(r["distance"], 6)))
    # down to (2, 0) stays inside; the wall from (10, 3) to (3, 3) has no foot for b, and (10, y) none inside for b
    assert got["b"] == [(3.0, 8.0, 1.0), (0.0, 8.0, 2.0), (2.0, 10.0, 2.0), (2.0, 0.0, 8.0)] or sorted(got["b"]) == sorted([(3.0, 8.0, 1.0), (0.0, 8.0, 2.0), (2.0, 10.0, 2.0), (2.0, 0.0, 8.0)])
    # the foot at the end of two walls, (3, 3), counts once; so does the wall's end at their other side
    assert got["c"][0] == (3.0, 0.0, 1.0) and got["c"].count((3.0, 3.0, 2.0)) == 1 and (0.0, 1.0, 3.0) in got["c"] and (10.0, 1.0, 7.0) in got["c"]
    assert (3.0, 10.0, 9.0) in got["c"]  # along the inner wall: the border is inside
