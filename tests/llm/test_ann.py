import math

import numpy as np
from pyspark.sql import functions as F

from ductwise.llm import ann


def brute(rows, k=5, every=50):
    ok = {i: np.array(v, np.float64) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    ids = np.array(sorted(ok))
    m = np.stack([ok[i] for i in ids])
    for q in ids[ids % every == 0]:
        s = ann.cosines(np.repeat(ok[q][None], len(m), 0), m)
        out[int(q)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_recall_and_exact_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in v.collect()])
    got = {}
    for r in ann.nearest(v).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    exact = {q: dict(brute_all) for q, brute_all in want.items()}
    hits = [(i in exact[q]) for q, x in got.items() for i, _ in x]
    assert sum(hits) >= 0.9 * len(hits)
    for q, x in got.items():
        assert all(math.isclose(s, exact[q].get(i, s), rel_tol=1e-12) for i, s in x)
        assert [(-s, i) for i, s in x] == sorted((-s, i) for i, s in x)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (300, [1.0, 0.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 300, 1.0), (0, 3, 2, 0.0), (300, 1, 0, 1.0), (300, 2, 1, 1.0), (300, 3, 2, 0.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, x) for i, x in rows])
    got = {}
    for r in ann.nearest(v, aim=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    same = [q for q in want if q % 3]
    assert all(got[q] == [i for i, _ in want[q]] for q in same)


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    a, b = ann.scan(q, x, 6)
    left = [set(b[a == i].tolist()) for i in range(20)]
    found = sum(len(set(np.argsort(-(x @ q[i]))[:6].tolist()) & left[i]) for i in range(20))
    assert found >= 0.95 * 120 and len(a) < 0.1 * 20 * 3000


def test_repeated_rows_are_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.1])]
    got = sorted(tuple(r)[:3] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).collect())
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, x, strict=True)) / math.hypot(*v) / math.hypot(*x), d) for j, (d, x) in enumerate(rows) if j != i)[:4]
            want += [(q, r + 1, d) for r, (_, d) in enumerate(near)]
    assert got == sorted(want)
