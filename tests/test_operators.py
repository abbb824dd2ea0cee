import datetime
import random

import pytest
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo
from ductwise.functions import reference as ref
from ductwise.operators import catalog, compare, grid, network


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("flow", "dn"), [(3.5, 50), (3.51, 65), (80.0, 200), (22501.9, 1400), (22502.0, None)])
def test_pipe_for_flow(spark, flow, dn):
    assert one(spark, ref.dn_for_flow(F.lit(flow))) == dn


def test_brackets_and_score(spark):
    assert [one(spark, ref.chamber_cost(F.lit(d))) for d in (50, 200, 250, 500, 600, 1400)] == [3000000, 3000000, 5000000, 5000000, 8000000, 12000000]
    assert [one(spark, ref.clearance(F.lit(d))) for d in (400, 500, 800, 900)] == [5, 7, 7, 9]
    assert round(one(spark, ref.score(F.lit(51094590.0), F.lit(220.2))), 3) == 2.091
    assert round(one(spark, ref.score(F.lit(13974800.0), F.lit(100.0))), 4) == 0.6913
    assert one(spark, ref.penalty(F.lit(10.0))) == 105000000
    assert [one(spark, ref.round_half_up(F.lit(x), 0)) for x in (2.5, -2.5, -2.6)] == [3, -2, -3]


def test_unknown_rule_is_the_default(spark):
    rows = spark.createDataFrame([("road",), ("metro",), (None,)], "restriction_type string")
    got = {r["restriction_type"]: (r["rule"], r["min_distance"], r["k"]) for r in ref.with_rule(rows).collect()}
    assert got == {"road": ("SPECIAL", 1.5, 1.6), "metro": ("FORBIDDEN", 1.0, 1.0), None: ("FORBIDDEN", 1.0, 1.0)}


def test_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geo.point_segment_distance(*lit(0, 5, 0, 0, 10, 0))) == 5
    assert one(spark, geo.point_segment_distance(*lit(3, 4, 0, 0, 0, 0))) == 5
    assert one(spark, geo.turn_degrees(*lit(0, 0, 1, 0, 1, 1))) == pytest.approx(90)
    assert one(spark, geo.turn_degrees(*lit(0, 0, 0, 0, 1, 1))) is None
    assert one(spark, geo.properly_cross(tuple(lit(0, 0, 2, 2)), tuple(lit(0, 2, 2, 0))))
    assert not one(spark, geo.properly_cross(tuple(lit(0, 0, 2, 2)), tuple(lit(2, 2, 3, 0))))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))])
    assert one(spark, geo.ring_contains(ring, F.lit(1.0), F.lit(1.0))) and not one(spark, geo.ring_contains(ring, F.lit(5.0), F.lit(1.0)))
    assert one(spark, geo.ring_area(ring)) == 8 and one(spark, geo.line_length(ring)) == 12
    east, north = one(spark, F.struct(*geo.utm_forward(F.lit(39.0), F.lit(0.0))))
    assert (east, north) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))


def test_grid_joins_as_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.randrange(300), rng.randrange(300)) for i in range(60)]
    oth = [(i, rng.randrange(300), rng.randrange(300)) for i in range(80)] + [(999, 5000, 5000)]
    a, b = spark.createDataFrame(pts, "k long, x long, y long"), spark.createDataFrame(oth, "r long, rx long, ry long")
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    got = sorted((r["k"], r["r"], r["d2"]) for r in grid.within_radius(a, b, "x", "y", "rx", "ry", 30.0).collect())
    assert got == sorted((p[0], q[0], d2(p, q)) for p in pts for q in oth if d2(p, q) <= 900)
    far = spark.createDataFrame([*pts, (500, 4000, 4400)], "k long, x long, y long")
    got = {r["k"]: (r["d2"], r["r"]) for r in grid.nearest(far, b, "k", "x", "y", "r", "rx", "ry", 5.0).collect()}
    assert got == {p[0]: min((d2(p, q), q[0]) for q in oth) for p in [*pts, (500, 4000, 4400)]}
    assert grid.nearest(a, b.limit(0), "k", "x", "y", "r", "rx", "ry", 5.0).collect() == []


def test_chains(spark):
    tree = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (10, 11), (11, 10), (12, 10), (20, 99), (21, 20)], "node long, parent long")
    got = {r["node"]: r["state"] for r in network.chain_states(tree, [0]).collect()}
    assert got == {0: "root", 1: "root", 2: "root", 3: "root", 10: "cycle", 11: "cycle", 12: "cycle", 20: "broken", 21: "broken"}
    good = tree.where("node < 10").withColumn("flow", F.col("node") + 1)
    assert {r["node"]: (r["total"], r["n"], r["depth"]) for r in network.subtree_sums(good, "flow").collect()} == {0: (10, 4, 0), 1: (9, 3, 1), 2: (7, 2, 2), 3: (4, 1, 3)}
    with pytest.raises(RuntimeError):
        network.ancestors(tree.where("node in (10, 11)"), most=5)


def test_pieces_of_a_segment(spark):
    """Ties at 50 m with 20 t/h and at 150 m with 30, and 5 t/h at the far end of 200 m."""
    ties = spark.createDataFrame([("m1", 50.0, 20.0), ("m1", 150.0, 30.0), ("m1", 200.0, 5.0)], "seg string, t double, flow double")
    got = network.suffix_sum(ties, ["seg"], ["t"], "flow", "load").orderBy("t").collect()
    assert [(r["t"], r["load"]) for r in got] == [(50, 55), (150, 35), (200, 5)]


def test_merged_intervals(spark):
    rows = spark.createDataFrame([("a", 0.0, 5.0, 1.6), ("a", 1.0, 2.0, 2.0), ("a", 5.005, 6.0, 1.1), ("a", 7.0, 8.0, 1.0)], "line string, low double, high double, k double")
    assert sorted(map(tuple, network.merge_intervals(rows, ["line"], "low", "high", "k").collect())) == [("a", 0.0, 6.0, 2.0), ("a", 7.0, 8.0, 1.0)]


def test_edits_in_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "fid long, value string")
    value = lambda fid, v: spark.createDataFrame([(fid, v)], "fid long, value string")
    ids = lambda *f: spark.createDataFrame([(x,) for x in f], "fid long")
    out = catalog.apply_edits(rows, [catalog.Set("value", value(1, "x")), catalog.Set("value", value(1, "y")), catalog.Remove(ids(2)), catalog.Add(value(4, "d")), catalog.Set("value", value(4, None))])
    assert sorted((r["fid"], r["value"]) for r in out.collect()) == [(1, "y"), (3, "c"), (4, None)]
    assert [r["fid"] for r in catalog.missing(ids(2, 9), rows).collect()] == [9]


def test_retention_and_issues(spark):
    at = lambda h: datetime.datetime(2024, 1, 10) - datetime.timedelta(hours=h)
    runs = spark.createDataFrame([(i, 1, at(10 * i), i == 4) for i in range(8)], "run_id long, dataset_id long, created_at timestamp, pinned boolean")
    gone = catalog.expired(runs, 2, 25, F.lit(at(0)))
    assert sorted(r["run_id"] for r in gone.collect()) == [3, 5, 6, 7]
    issues = spark.createDataFrame([("c", "WARNING", "f1", 1), ("c", "ERROR", None, 2), ("edit.x", "INFO", "f2", 3), ("d", "INFO", "f3", 4)], "code string, severity string, feature_id string, seq long")
    assert {tuple(r) for r in catalog.issue_counts(issues).where("code = 'c'").collect()} == {("c", "ERROR", 2, 1)}
    left = catalog.inherited_issues(issues, spark.createDataFrame([("f3",)], "fid string"))
    assert sorted(r["seq"] for r in left.collect()) == [1, 2]
    assert [(r["seq"], r["n"]) for r in catalog.with_examples(issues, 1).where("code = 'c'").collect()] == [(1, 2)]


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "k long, p string, q string")
    b = spark.createDataFrame([(1, "x", "n"), (2, "w", "z")], "k long, p string, q string")
    assert sorted(map(tuple, compare.changed(a, b, "k", ["p", "q"]).collect())) == [(1, "q", None, "n"), (2, "p", "y", "w")]
