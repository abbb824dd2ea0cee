import math
import random

import pytest
from pyspark.sql import functions as F

from ductwise.operators import overlay

SCHEMA = "id long, ax double, ay double, bx double, by double"


def near(x, y, s):
    ax, ay, bx, by = s
    d2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2)) if d2 else 0.0
    return math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)


def test_near_part_as_sampled(spark):
    rng = random.Random(5)
    cases = [(i, *(float(rng.randint(-4, 4)) if i % 2 else rng.uniform(-4, 4) for _ in range(8))) for i in range(300)]
    names = "ax ay bx by cx cy ex ey".split()
    rows = spark.createDataFrame(cases, "k int, " + ", ".join(f"{n} double" for n in names))
    found = overlay.with_near_part(rows, tuple(F.col(c) for c in names[:4]), tuple(F.col(c) for c in names[4:]), 1.0)
    got = {r["k"]: (r["low"], r["high"]) for r in found.collect()}
    n = 2000
    for k, *c in cases:
        if c[:2] == c[2:4]:
            continue
        held = [near(c[0] + (c[2] - c[0]) * (i + 0.5) / n, c[1] + (c[3] - c[1]) * (i + 0.5) / n, c[4:]) <= 1 for i in range(n)]
        low, high = got[k]
        assert (0 if low is None else high - low) == pytest.approx(sum(held) / n, abs=0.002), c


def test_union_of_overlapping_pieces(spark):
    rows = [
        (1, 0.0, 0.0, 10.0, 0.0),
        (2, 10.0, 0.0, 0.0, 0.0),  # the same, the other way round
        (3, 5.0, 0.0, 15.0, 0.0),  # overlaps
        (4, 2.0, 0.0, 3.0, 0.0),  # inside
        (5, 4.0, -5.0, 4.0, 5.0),  # crosses
        (6, 7.0, 7.0, 7.0, 7.0),  # no length
        (7, 14.0, 0.0, 15.0, 1.0),  # only touches
    ]
    lines = spark.createDataFrame([*rows, (8, None, 0.0, 1.0, 1.0)], SCHEMA)
    got = {r["id"]: r["n"] for r in overlay.union(lines, 4.0).groupBy("id").agg(F.sum("length").alias("n")).collect()}
    assert got == pytest.approx({1: 10.0, 3: 5.0, 5: 10.0, 7: math.sqrt(2)})
    pieces = sorted((round(r["ax"], 6), round(r["bx"], 6)) for r in overlay.noded(lines, 4.0).where("id in (1, 3)").collect())
    assert pieces == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 10), (10, 14), (14, 15)]
    assert overlay.union(lines.limit(0), 4.0).count() == overlay.noded(lines.limit(0), 4.0).count() == 0


def test_noded_pieces_never_cross(spark):
    rng = random.Random(9)
    lines = spark.createDataFrame([(i, *(float(rng.randint(0, 12)) for _ in range(4))) for i in range(60)], SCHEMA)
    pieces = overlay.noded(lines, 5.0).collect()
    want = overlay.union(lines, 5.0).agg(F.sum("length")).first()[0]
    assert sum(p["length"] for p in pieces) == pytest.approx(want)
    place = lambda x, y: (round(x, 7), round(y, 7))
    assert len({frozenset((place(p["ax"], p["ay"]), place(p["bx"], p["by"]))) for p in pieces}) == len(pieces)
    for i, p in enumerate(pieces):
        for q in pieces[:i]:
            a, b, c, d = (p["ax"], p["ay"]), (p["bx"], p["by"]), (q["ax"], q["ay"]), (q["bx"], q["by"])
            side = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
            assert not (side(a, b, c) * side(a, b, d) < -1e-9 and side(c, d, a) * side(c, d, b) < -1e-9)


def test_difference_as_sampled(spark):
    rng = random.Random(3)
    net = lambda: [(i, *(rng.uniform(0, 20) for _ in range(4))) for i in range(25)]
    a, b = net(), net()
    a.append((99, *a[0][1:]))
    row = overlay.compare_lengths(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), size=6.0).first()

    def sampled(x, y):
        common = away = 0.0
        for _, *s in {tuple(r[1:]): r for r in x}.values():
            n, length = 800, math.hypot(s[2] - s[0], s[3] - s[1])
            held = sum(any(near(s[0] + (s[2] - s[0]) * (i + 0.5) / n, s[1] + (s[3] - s[1]) * (i + 0.5) / n, r[1:]) <= 1 for r in y) for i in range(n)) / n
            common, away = common + held * length, away + (1 - held) * length
        return common, away

    common, only_a = sampled(a, b)
    assert row["common"] == pytest.approx(common, abs=0.5)
    assert row["only_a"] == pytest.approx(only_a, abs=0.5)
    assert row["only_b"] == pytest.approx(sampled(b, a)[1], abs=0.5)
