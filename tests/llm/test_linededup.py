import random

import numpy as np
from pyspark.sql import functions as F

from ductwise.llm import linededup


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def run(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), removed="gone", **more).collect()
    return {r["doc_id"]: (r["text"], r["gone"]) for r in out}


def test_passages_go_from_later_documents_exactly(spark):
    rng = random.Random(1)
    for n in (50, 51, 60, 90, 140, 300):
        p = passage(rng, n)
        texts = [passage(rng, rng.randrange(0, 80)) + " " + p.replace(" ", "\n", 3) + " " + passage(rng, rng.randrange(0, 80)) for _ in range(5)]
        got = run(spark, texts)
        assert got[0] == (texts[0], 0)
        for i in range(1, 5):
            assert got[i][1] == n
            want = texts[i].replace("\n", " ").replace(p, "").split()
            assert got[i][0].split() == want


def test_short_and_partly_shared_runs_stay(spark):
    rng = random.Random(2)
    p = passage(rng, 49)
    texts = [passage(rng, 30) + " " + p + " " + passage(rng, 30) for _ in range(4)]
    assert all(v == (t, 0) for v, t in zip(run(spark, texts).values(), texts, strict=True))


def test_windows_and_minima():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    h[200:260] = h[20:80]
    x = linededup.window_hashes(h)
    assert len(x) == 400 - 25 and (x[200 : 200 + 35] == x[20 : 20 + 35]).all() and len(set(x.tolist())) == len(x) - 35
    at = linededup.winnow(x)
    assert (np.diff(at) <= linededup.WINDOW).all() and at[0] < linededup.WINDOW
    assert set((at[(at >= 200) & (at < 235)] - 180).tolist()) & set(at.tolist())
    flat = linededup.winnow(np.zeros(1000, np.uint64))
    assert len(flat) < 100 and (np.diff(flat) <= linededup.WINDOW).all()


def test_copies_and_odd_rows(spark, odd, none, documents):
    out = linededup.remove_repeats(odd.withColumn("tx", F.lit(1)).withColumn("spans", F.lit(2)))
    assert out.columns == [*odd.columns, "tx", "spans"]
    assert sorted(map(str, out.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert linededup.remove_repeats(none).collect() == []
    rng = random.Random(4)
    long = passage(rng, 30_000)
    got = run(spark, [long, long + " end", None, "", long])
    assert got[0] == (long, 0) and got[1][0].split() == ["end"] and got[4][0].strip() == "" and got[2][0] is None
    same = spark.createDataFrame([(1, long), (1, long), (1, "other " + long), (None, long)], "doc_id long, text string")
    texts = sorted(len((r["text"] or "").split()) for r in linededup.remove_repeats(same).collect())
    assert texts in ([1, 30_000, 30_000, 30_000], [0, 0, 30_000, 30_001])
    assert linededup.remove_repeats(documents).count() == documents.count()


def test_no_run_of_fifty_words_is_left(spark, documents):
    rows = linededup.remove_repeats(documents).select("doc_id", "text").orderBy("doc_id").collect()
    seen, left = {}, 0
    for r in rows:
        w = r["text"].split()
        for i in range(len(w) - 49):
            if len(set(w[i : i + 50])) < 20:
                continue  # one word over and over
            left += seen.setdefault(tuple(w[i : i + 50]), r["doc_id"]) != r["doc_id"]
    assert left == 0
