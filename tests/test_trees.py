import random
import time

import pytest

from ductwise.operators import catalog, trees, validate

SCHEMA = "node long, parent long, kind string, v long, d double"


def forest(n, seed, deep):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i < 3 else (i - 1 - rng.randrange(2) if deep else rng.randrange(i))
        rows.append((i, parent, rng.choice("aab") if rng.random() < 0.9 else None, rng.randrange(-5, 9) if rng.random() < 0.9 else None, float(rng.randrange(40))))
    return rows


def ways(rows):
    """Each node's way up, itself first; None where it never ends."""
    up, out = {}, {}
    for n, p, *_ in rows:
        up[n] = min(x for x in (p, up.get(n)) if x is not None) if p is not None or up.get(n) is not None else None
    for n in up:
        way, at = [], n
        while at is not None and at in up and at not in way:
            way.append(at)
            at = up[at]
        out[n] = None if at in way else way
    return out


@pytest.mark.parametrize(("deep", "hot"), [(False, 100_000), (True, 3)])
def test_as_brute_force(spark, monkeypatch, deep, hot):
    monkeypatch.setattr(trees, "HOT", hot)
    rows = forest(60, 3, deep) + [(500, 501, "a", 1, 1.0), (501, 502, "a", 1, 1.0), (502, 500, "a", 1, 1.0), (503, 502, "b", 1, 1.0), (504, 900, "b", 7, 2.0)]
    frame, way = spark.createDataFrame(rows, SCHEMA), ways(rows)
    by = {r[0]: r for r in rows}
    got = {r["node"]: r for r in trees.climb(frame, ["d"]).collect()}
    for n, w in way.items():
        assert got[n]["cyclic"] == (w is None)
        if w:
            assert (got[n]["top"], got[n]["depth"], got[n]["d"]) == (w[-1], len(w) - 1, sum(by[x][4] for x in w[:-1]))
    below = {n: [x for x, w in way.items() if w and n in w] for n in way}
    got = {r["node"]: r for r in trees.gather(frame, sums=["v"], maxes=["d"]).collect()}
    assert set(got) == {n for n, w in way.items() if w}
    for n, r in got.items():
        assert (r["below"], r["depth"], r["v"], r["d"]) == (len(below[n]), len(way[n]) - 1, sum(by[x][3] or 0 for x in below[n]), max(by[x][4] for x in below[n]))

    def stretch(n):
        w = way[n]
        return w[: next((i for i, x in enumerate(w) if by[x][2] != by[n][2]), len(w))]

    got = {r["node"]: r for r in trees.runs_up(frame, "kind", ["d"]).collect()}
    for n, w in way.items():
        if w:
            run = stretch(n)
            longest = max(sum(by[y][4] for y in stretch(x)) for x in below[n] if n in stretch(x))
            assert (got[n]["last"], got[n]["edges"], got[n]["d"], got[n]["longest_d"]) == (run[-1], len(run), sum(by[x][4] for x in run), longest)
    got = {r["node"]: (r["runs"], r["longest"]) for r in trees.path_runs(frame, "kind").collect()}
    want = {}
    for n, w in way.items():
        if w:
            sizes, at = [], n
            while at is not None:
                run = stretch(at)
                sizes.append(len(run))
                at = way[run[-1]][1] if len(way[run[-1]]) > 1 else None
            want[n] = (len(sizes), max(sizes))
    assert got == want


def test_empty_repeated_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trees.climb(none).collect() == trees.gather(none, sums=["v"]).collect() == trees.runs_up(none, "kind", ["d"]).collect() == trees.path_runs(none, "kind").collect() == []
    rows = [(1, None, "a", 2, 1.0), (2, 1, "a", 3, 1.0), (2, 3, "b", 9, 5.0), (2, None, "b", 9, 5.0), (3, None, "a", 1, 1.0), (None, 1, "a", 8, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {(r["node"], r["parents"]) for r in trees.double_parents(frame).collect()} == {(2, 2)}
    assert {r["node"]: r["v"] for r in trees.gather(frame, sums=["v"]).collect()} == {1: 5, 2: 3, 3: 1}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = trees.look_up
    monkeypatch.setattr(trees, "look_up", lambda *a: rounds.append(1) or plain(*a))
    n = 1_000_000
    chain = spark.range(n).selectExpr("id as node", "nullif(id, 0) - 1 as parent", "1L as v")
    ends = trees.gather(chain, sums=["v"]).selectExpr("sum(v) as s", "max(depth) as d", "max(v) as m").first()
    assert (ends["s"], ends["d"], ends["m"]) == (n * (n + 1) // 2, n - 1, n)
    assert len(rounds) < 25


SEGMENTS = "variant_id long, fid string, start_node string, end_node string, flow double, dn int, length double"


def test_rings_and_two_parents_are_findings(spark):
    began = time.time()
    ring = [(1, f"s{i}", f"n{i}", f"n{(i + 1) % 40}", 1.0, 50, 1.0) for i in range(40)]
    into = [(1, "in", "c1", "n0", 1.0, 50, 1.0), (1, "two", "c1", "n5", 1.0, 50, 1.0), (1, "ok", "c2", "t", 2.0, 50, 1.0), (1, "lost", "c3", "x", 1.0, 50, 1.0)]
    segments = spark.createDataFrame(ring + into, SEGMENTS)
    ties = spark.createDataFrame([(1, "t")], "variant_id long, node string")
    consumers = spark.createDataFrame([("c1", 1.0), ("c2", 2.0), ("c3", 1.0)], "fid string, flow double")
    found = {(r["rule"], r["feature_id"]) for r in validate.reach(segments, ties).collect()}
    assert found == {("R-NET-4", s[1]) for s in ring} | {("R-NET-4", "in"), ("R-NET-4", "two"), ("R-NET-1", "lost")}
    assert validate.one_parent(segments).count() == 1
    assert validate.flows(segments, consumers).collect() == [] and validate.run_lengths(segments, consumers).collect() == []
    assert time.time() - began < 60


def test_every_segment_of_a_long_way_is_named(spark):
    """Two branches join; the longer one with the shared part is over the limit, the other is not."""
    rows = [(1, "a1", "c1", "m", 1.0, 50, 150.0), (1, "a2", "m", "j", 1.0, 50, 100.0), (1, "b", "c2", "j", 1.0, 50, 90.0), (1, "s", "j", "t", 2.0, 50, 100.0), (1, "u", "t", "z", 2.0, 100, 10.0)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    consumers = spark.createDataFrame([("c1", 1.0), ("c2", 1.0)], "fid string, flow double")
    way = {r["fid"]: r["way"] for r in validate.longest_ways(segments, consumers).collect()}
    assert way == {"a1": 350.0, "a2": 350.0, "b": 190.0, "s": 350.0, "u": 10.0}
    only = spark.createDataFrame([("c2", 1.0)], "fid string, flow double")
    assert {r["fid"]: r["way"] for r in validate.longest_ways(segments, only).collect()} == {"b": 190.0, "s": 190.0, "u": 10.0}


def test_versions_in_a_circle(spark):
    rows = [(1, None, 1), (2, 1, 2), (3, 2, 3), (7, 8, 1), (8, 7, 2), (9, 8, 3)]
    versions = spark.createDataFrame(rows, "id long, parent_id long, version int")
    assert {(r["root_id"], r["n"], r["newest"], r["next_version"]) for r in catalog.families(versions).collect()} == {(1, 3, 3, 4), (None, 3, 9, 4)}
    assert {r["id"] for r in catalog.descendants(versions, 2).collect()} == {2, 3}
    assert {r["id"] for r in catalog.descendants(versions, 8).collect()} == {7, 8, 9}


def test_parts_as_brute_force(spark):
    from ductwise.operators import components

    rng = random.Random(6)
    edges = [(i, rng.randrange(80), rng.randrange(80)) for i in range(60)] + [(99, 200, 200)]
    marked = [(n,) for n in range(0, 80, 7)] * 2
    root = {n: n for _, a, b in edges for n in (a, b)}
    for _ in edges:
        for _, a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {}
    for r in set(root.values()):
        own = [i for i, a, _ in edges if root[a] == r]
        nodes = [n for n in root if root[n] == r]
        want[r] = (min(own), len(own), len(nodes), len({n for n, in marked} & set(nodes)))
    found = components.parts(spark.createDataFrame(edges, "id long, a long, b long"), spark.createDataFrame(marked, "node long"))
    assert {r["root"]: (r["first"], r["edges"], r["nodes"], r["marks"]) for r in found.collect()} == want
    assert components.parts(spark.createDataFrame([], "id long, a long, b long"), spark.createDataFrame(marked, "node long")).collect() == []
