import math
import random

import pytest

from ductwise.operators import topology

ENDS = "id long, sx double, sy double, ex double, ey double"
PLACE = "id long, x double, y double"


def brute_nodes(points, radius):
    """seq -> node, one point after the other."""
    nodes, at = [], {}
    for seq, x, y in sorted(points):
        near = [(math.sqrt((x - nx) ** 2 + (y - ny) ** 2), n) for n, nx, ny in nodes if math.sqrt((x - nx) ** 2 + (y - ny) ** 2) <= radius]
        if not near:
            nodes.append((seq, x, y))
        at[seq] = min(near)[1] if near else seq
    return at


@pytest.mark.parametrize("wide,step", [(6.0, 0.0), (40.0, 0.0), (4.0, 0.25)])
def test_first_come_as_one_by_one(spark, wide, step):
    rng = random.Random(int(wide))
    place = lambda: (round(rng.uniform(-wide, wide) / step) * step if step else rng.uniform(-wide, wide))
    points = [(i, place(), place()) for i in rng.sample(range(1000), 300)]
    points += [(2000 + i, *points[i][1:]) for i in range(30)]  # the same places again
    got = topology.snapped(spark.createDataFrame([*points, (5000, None, 1.0)], "seq long, x double, y double")).collect()
    assert {r["seq"]: r["node"] for r in got} == brute_nodes(points, 0.5)


def test_row_of_points_that_wait_for_one_another(spark):
    points = [(i, i * 0.4, 0.0) for i in range(9)]
    got = topology.first_come(spark.createDataFrame(points, "seq long, x double, y double")).collect()
    assert sorted(r["seq"] for r in got) == [0, 2, 4, 6, 8]
    assert topology.first_come(spark.createDataFrame([], "seq long, x double, y double")).count() == 0


def brute_walk(segments, chambers, source):
    """The walk from the source, one object after the other."""
    at = brute_nodes([p for i, sx, sy, ex, ey in segments for p in ((2 * i, sx, sy), (2 * i + 1, ex, ey))], 0.5)
    place = {2 * i: (sx, sy) for i, sx, sy, _, _ in segments} | {2 * i + 1: (ex, ey) for i, _, _, ex, ey in segments}
    nodes = set(at.values())
    nearest = lambda x, y: min((math.hypot(place[n][0] - x, place[n][1] - y), n) for n in nodes)
    holds, placed = {}, {}
    for c, x, y in sorted(chambers):
        d, n = nearest(x, y)
        if d <= 2:
            placed[c] = n
            holds.setdefault(n, c)
    root = nearest(*source[1:])[1]
    into, out, queue, done = {root: ("source", source[0])}, {}, [root], set()
    while queue:
        n = queue.pop(0)
        way = into[n]
        if n in holds:
            out["chamber", holds[n]] = way
            way = ("chamber", holds[n])
        for i, *_ in segments:
            ends = at[2 * i], at[2 * i + 1]
            if n in ends and i not in done:
                done.add(i)
                out["segment", i] = way
                other = ends[1] if ends[0] == n else ends[0]
                if other not in into:
                    into[other] = ("segment", i)
                    queue.append(other)
    for c, n in placed.items():
        if n in into:
            out.setdefault(("chamber", c), into[n])
    return out, {i for i, *_ in segments} - done


def test_walk_from_the_source(spark):
    rng = random.Random(4)
    shake = lambda: rng.uniform(-0.1, 0.1)
    spots = [(10.0 * (k % 6), 10.0 * (k // 6)) for k in range(30)]
    segments = []
    for k in range(1, 30):  # a tree over the spots, each piece drawn either way; spots 24 and on are apart
        up = rng.randrange(24, k) if k > 24 else rng.randrange(k) if k != 24 else None
        if up is not None:
            ends = [tuple(c + shake() for c in spots[j]) for j in ((k, up) if rng.random() < 0.5 else (up, k))]
            segments.append((k, *ends[0], *ends[1]))
    chambers = [(100 + k, spots[k][0] + 1, spots[k][1]) for k in (0, 3, 5, 9, 11, 20, 25)] + [(300, *spots[5]), (301, 500.0, 500.0), (99, spots[9][0], spots[9][1] + 0.5)]
    source = (7, spots[0][0] + 0.3, spots[0][1])
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((segments, ENDS), (chambers, PLACE), ([source], PLACE))]
    got, wrong = topology.derive(*frames)
    want, apart = brute_walk(segments, chambers, source)
    assert {(r["kind"], r["id"]): (r["upstream_kind"], r["upstream"]) for r in got.collect()} == want
    assert {(r["id"], r["code"]) for r in wrong.collect()} == {(i, "network.detached_part") for i in apart}
    parts = topology.detached(frames[0], frames[2]).collect()
    assert [(r["segments"], r["first"]) for r in parts] == [(len(apart), min(apart))]
    away = spark.createDataFrame([(7, -100.0, -100.0)], PLACE)
    assert ("network.source_not_on_network" in {r["code"] for r in topology.derive(frames[0], frames[1], away)[1].collect()})
    assert topology.derive(*frames[:2], away.limit(0))[0].count() == topology.derive(frames[0].limit(0), *frames[1:])[0].count() == 0
