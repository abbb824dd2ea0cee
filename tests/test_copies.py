"""Tables in which shapes repeat: the geometry is worked out once for each different shape, and every copy gets its result."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ductwise.functions import clip
from ductwise.operators import grid, validate, zones
from ductwise.plans import oracle
from ductwise.plans import queries as plans

RINGS = "array<array<struct<x double, y double>>>"
SEGMENT = "ax double, ay double, bx double, by double"


def square(x, w):
    return [[(x, -1.0), (x + w, -1.0), (x + w, 1.0), (x, 1.0), (x, -1.0)]]


def copies(spark):
    segments = spark.createDataFrame([(i, 0.0, 0.0, 10.0 + i % 2, 0.0) for i in range(40)], f"k int, {SEGMENT}")
    areas = spark.createDataFrame([(i, square(1.0 + 3 * (i % 2), 2.0)) for i in range(30)], f"area int, rings {RINGS}")
    return segments, areas


def counted(monkeypatch, name):
    seen, before = [], getattr(clip, name)

    def count(df, *args, **named):
        seen.append(df.count())
        return before(df, *args, **named)

    monkeypatch.setattr(clip, name, count)
    return seen


def test_inside_cuts_equal_shapes_once(spark, monkeypatch):
    seen = counted(monkeypatch, "with_inside")
    segments, areas = copies(spark)
    got = zones.inside(segments, areas).select("k", "area", clip.length_inside(F.col("inside")).alias("part")).collect()
    assert seen == [4]
    assert {(r["k"], r["area"]) for r in got} == {(k, a) for k in range(40) for a in range(30)} and len(got) == 1200
    assert all(abs(r["part"] - 2 / (10 + r["k"] % 2)) < 1e-12 for r in got)


def test_stretches_of_equal_lines_are_merged_once(spark, monkeypatch):
    seen = counted(monkeypatch, "with_inside")
    segments, areas = copies(spark)
    lines = segments.withColumns({"fid": F.floor(F.col("k") / 2), "at": F.when(F.col("k") % 2 == 1, 10.0).otherwise(0.0)})
    got = zones.stretches(lines, areas, ["fid"], "at", gap=1.5).collect()
    assert seen == [4]
    assert sorted((r["fid"], r["low"], r["high"]) for r in got) == sorted((f, round(a + 1.0), round(a + 6.0)) for f in range(20) for a in (0, 10))


def test_crossings_test_equal_lines_once(spark, monkeypatch):
    seen = counted(monkeypatch, "kept")
    line = {"level": [(0.0, 0.0), (10.0, 0.0)], "upright": [(5.0, -5.0), (5.0, 5.0)], "bent": [(0.0, 0.0), (4.0, 4.0), (4.0, -4.0)], "away": [(90.0, 90.0), (95.0, 95.0)]}
    named = {f"{n}{i}": n for n in line for i in range(9)}
    rows = spark.createDataFrame([(v, f, line[n]) for v in (1, 2) for f, n in named.items()], "variant_id long, fid string, line array<struct<x double, y double>>")
    got = [(r["variant_id"], r["feature_id"], r["message"].split()[1]) for r in validate.crossings(rows).collect()]
    meet = {frozenset(p) for p in (("level", "upright"), ("level", "bent"))} | {frozenset(["bent"])}  # the middle of a bent line is no end of it
    want = {(v, a, b) for v in (1, 2) for a in named for b in named if a < b and frozenset([named[a], named[b]]) in meet}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(seen) < 40


def test_walls_are_measured_once(spark, monkeypatch):
    seen = counted(monkeypatch, "kept")
    areas = spark.createDataFrame([(i, 1.0 + i % 2, square(1.0 + 3 * (i % 2), 2.0)) for i in range(30)], f"fid int, min_distance double, rings {RINGS}")
    lines = spark.createDataFrame([(v, i, [(0.0, 2.5), (5.0, 2.5), (6.0, 2.5 + i % 2)]) for v in (1, 2) for i in range(12)], "variant_id long, fid int, line array<struct<x double, y double>>")
    got = {r["feature_id"]: (r["n"], r["first"]) for r in validate.near_walls_summary(lines, areas).collect()}
    assert max(seen) <= 16
    every = validate.near_walls(lines, areas).groupBy("feature_id").agg(F.count("*").alias("n"), F.min("message").alias("first")).collect()
    assert got == {r["feature_id"]: (r["n"], r["first"]) for r in every} == {str(i): (30, "too close to 1") for i in range(12)}


def met(monkeypatch, name):
    seen, before = [], getattr(grid, name)

    def count(left, right, *args):
        seen.append((left.count(), right.count()))
        return before(left, right, *args)

    monkeypatch.setattr(grid, name, count)
    return seen


def test_nearest_searches_each_place_once_in_small_cells(spark, monkeypatch):
    seen, sizes, before = met(monkeypatch, "within_radius"), [], grid.over_cells
    monkeypatch.setattr(grid, "over_cells", lambda df, x0, y0, x1, y1, size: sizes.append(size) or before(df, x0, y0, x1, y1, size))
    right = [(i, i * 7 % 20, i * 7 % 400 // 20) for i in range(1200)]
    left = [(i, i % 4 * 5.25, i % 4 * 2.5) for i in range(100)]
    got = grid.nearest(spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame(right, "r int, rx int, ry int"), "k", "x", "y", "r", "rx", "ry", 500.0).collect()
    want = {k: min(((rx - x) ** 2 + (ry - y) ** 2, r) for r, rx, ry in right) for k, x, y in left}
    assert {r["k"]: (r["d2"], r["r"]) for r in got} == want
    assert seen[0][0] == 4 and seen[0][1] == len({p[1:] for p in right}) and sizes[0] < 10


def test_smallest_box_of_equal_ones(spark, monkeypatch):
    seen = met(monkeypatch, "points_in_boxes")
    points = spark.createDataFrame([(i, i % 2, 1) for i in range(50)], "k int, x int, y int")
    boxes = spark.createDataFrame([(99 - i, 0, 0, 1 + i % 3, 2) for i in range(90)], "b int, x0 int, y0 int, x1 int, y1 int")
    got = grid.smallest_containing(points, boxes, "k", "b", "x", "y", "x0", "y0", "x1", "y1", 5.0).collect()
    assert {r["k"]: r["b"] for r in got} == dict.fromkeys(range(50), 12) and seen == [(2, 3)]


def test_sums_within_radius_count_every_copy(spark, monkeypatch):
    seen = met(monkeypatch, "within_radius")
    left = spark.createDataFrame([(i, i % 2 * 3, 0) for i in range(20)], "k int, x int, y int")
    right = spark.createDataFrame([(i, i % 3, 1) for i in range(60)], "r int, rx int, ry int")
    got = {r["k"]: (r["n"], r["d2"]) for r in grid.sums_within_radius(left, right, "k", "x", "y", "rx", "ry", 2.0).collect()}
    assert got == {k: (40, 60) if k % 2 == 0 else (20, 40) for k in range(20)} and seen == [(2, 3)]


def test_boxes_are_counted_with_their_copies(spark, monkeypatch):
    seen = met(monkeypatch, "points_in_boxes")
    points = spark.createDataFrame([(i, i % 2 * 9, 1) for i in range(50)], "k int, x int, y int")
    boxes = spark.createDataFrame([(99 - i, 0, 0, 8 + i % 3, 2) for i in range(90)], "b int, x0 int, y0 int, x1 int, y1 int")
    got = {r["k"]: (r["n"], r["first"]) for r in grid.sums_in_boxes(points, boxes, "k", "b", "x", "y", "x0", "y0", "x1", "y1", 5.0).collect()}
    assert got == {k: (60, 10) if k % 2 else (90, 10) for k in range(50)} and seen == [(2, 3)]


def test_corners_are_taken_from_the_line_once(spark, monkeypatch):
    seen = counted(monkeypatch, "kept")
    lines = {"sharp": [(0.0, 0.0), (10.0, 0.0), (0.0, 1.0)], "mild": [(0.0, 0.0), (10.0, 0.0), (20.0, 1.0)], "short": [(0.0, 0.0), (1.0, 1.0)], "twice": [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "late": [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0), (2.0, 0.0)]}
    rows = spark.createDataFrame([*((1, f, p) for f, p in lines.items()), (1, "none", None)], "variant_id long, fid string, line array<struct<x double, y double>>")
    assert sorted(r["feature_id"] for r in validate.turns(rows).collect()) == ["late", "sharp"] and seen == [4, 4, 4]


def few_places(spark, path):
    """Customers, suppliers and parts whose keys repeat the places and sizes of shapes."""
    key = lambda n, step: spark.range(n).select((F.floor(F.col("id") / 3) + F.col("id") % 3 * step).alias("k"))
    key(240, 7000).select(F.col("k").alias("c_custkey"), (F.col("k") % 25).alias("c_nationkey")).write.parquet(f"{path}/customer.parquet")
    key(60, 3000).select(F.col("k").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    key(300, 1000).select(F.col("k").alias("p_partkey"), (F.col("k") % 1000 % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["q50_segment_meets_area", "q28_clip_intervals", "q49_segments_meet", "q27_segment_crossings"])
def test_shapes_of_a_query_meet_once(spark, tmp_path, monkeypatch, name):
    """As the SQL says, while only different shapes are dealt out to cells: 80 segments of 240, 20 areas of 60, 100 rectangles of 300."""
    path, seen, cells = few_places(spark, tmp_path), [], grid.over_cells
    monkeypatch.setattr(grid, "over_cells", lambda df, *a: seen.append(df.count()) or cells(df, *a))
    rows = plans.QUERIES[name](spark, path)
    assert seen and set(seen) <= {80, 20, 100}
    base = duckdb.connect()
    for t in ("customer", "supplier", "part"):
        base.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    columns = ", ".join(rows.columns)
    want = base.execute(f"select {columns} from ({oracle.SQL[name]})").fetchall()
    assert want and sorted(tuple(r) for r in rows.collect()) == sorted(want)


def test_merged_stretches_of_copies_are_those_of_shapes(spark, tmp_path, monkeypatch):
    """Only different shapes are dealt out to cells. The SQL has each area once, as it leaves the order of equal stretches open."""
    path, seen, cells, name = few_places(spark, tmp_path), [], grid.over_cells, "q77_merged_stretches"
    monkeypatch.setattr(grid, "over_cells", lambda df, *a: seen.append(df.count()) or cells(df, *a))
    rows = plans.QUERIES[name](spark, path)
    assert sorted(seen) == [20, 80]
    base = duckdb.connect(config={"threads": 1})
    base.execute(f"create view customer as select * from '{path}/customer.parquet/*.parquet'")
    base.execute(f"create view supplier as select distinct s_suppkey % 3000 as s_suppkey from '{path}/supplier.parquet/*.parquet'")
    want = base.execute(f"select {', '.join(rows.columns)} from ({oracle.SQL[name]})").fetchall()
    assert want and sorted(tuple(r) for r in rows.collect()) == sorted(want)
