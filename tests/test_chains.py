import random
from collections import defaultdict

from ductwise.operators import chains

SCHEMA = "id long, a long, b long, length double"


def brute(rows):
    """Each line walked piece by piece."""
    at, by_id, out = defaultdict(list), {r[0]: r for r in rows}, {}
    for i, a, b, _ in rows:
        at[a].append((i, 0))
        at[b].append((i, 1))

    def on(i, e):
        ends = at[by_id[i][1 + e]]
        return next(x for x in ends if x != (i, e)) if len(ends) == 2 else None

    for i in by_id:
        lines = []
        for d in (0, 1):  # back to an end, going the way d
            here, way, seen = i, d, set()
            while (nxt := on(here, 1 - way)) and (here, way) not in seen:
                seen.add((here, way))
                here, way = nxt
            lines.append(None if nxt else here * 2 + way)
        if None in lines:
            ring, todo = {i}, [i]
            while todo:
                k = todo.pop()
                for e in (0, 1):
                    if (n := on(k, e)) and n[0] not in ring:
                        ring.add(n[0])
                        todo.append(n[0])
            out[i] = (min(ring), None, None, None, len(ring), True)
            continue
        here, way = min(lines) // 2, 1 - min(lines) % 2
        walk, length = [], 0.0
        while True:
            walk.append((here, way, length))
            length += by_id[here][3]
            nxt = on(here, 1 - way)
            if not nxt:
                break
            here, way = nxt
        place = next(k for k, w in enumerate(walk) if w[0] == i)
        out[i] = (walk[0][0], place, walk[place][1] == 0, walk[place][2], len(walk), False)
    return out


def test_lines_as_walked(spark):
    rng = random.Random(8)
    rows = [(i, *rng.sample((n, n + 1), 2), float(rng.randint(1, 9))) for i, n in enumerate(rng.sample(range(1, 60), 50))]  # chains with gaps
    rows += [(100 + i, rng.randrange(200, 240), rng.randrange(200, 240), 1.0) for i in range(36)]  # anything
    rows += [(200, 300, 301, 1.0), (201, 302, 301, 2.0), (202, 302, 300, 3.0), (203, 400, 400, 1.0), (204, 500, 501, 4.0), (205, 501, 500, 4.0)]  # rings
    frame = spark.createDataFrame([*rows, (900, None, 1, 1.0)], SCHEMA)
    got = {r["id"]: tuple(r)[1:] for r in chains.merged(frame).select("id", "line", "position", "forward", "at", "pieces", "ring").collect()}
    assert got == brute(rows)
    lines = chains.merged_lines(frame)
    assert {r["line"] for r in lines.collect()} == {v[0] for v in got.values()}
    assert chains.merged(frame.limit(0)).count() == 0
