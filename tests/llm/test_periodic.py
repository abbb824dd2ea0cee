import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ductwise.llm import periodic
from ductwise.llm.queries import _OP13, op13_periodic
from tests.llm.conftest import DATA


def plain_runs(w):
    """Every (start, length, period) by trying all periods at all places."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, m, p) for (s, m), p in found.items())


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = None
    for s, m, p in found:
        if best is None or m * best[2] > best[1] * p:
            best = (s, m, p)
        elif m * best[2] == best[1] * p:
            best = min(best, (s, m, p), key=lambda r: (r[0], r[2]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_documents_as_brute_force_and_sql(spark, documents):
    got = sorted(map(tuple, op13_periodic(spark, DATA).select(NAMES).collect()))
    assert got == sorted(plain(r["doc_id"], r["text"]) for r in documents.collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(NAMES)} from ({_OP13})").fetchall())


def test_random_words_as_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters, w = rng.randrange(120), rng.choice([1, 2, 3, 6, 50]), []
        while len(w) < n:
            if rng.random() < 0.4 and w:
                p = rng.randrange(1, min(len(w), 14) + 1)
                w += (w[-p:] * 9)[: rng.randrange(1, p * 7 + 1)]
            else:
                w.append(rng.randrange(letters))
        w = w[:n]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_strongest_and_what_stays():
    assert periodic.strongest([(5, 12, 3), (0, 8, 2), (0, 8, 2), (9, 7, 2)]) == (0, 8, 2)
    assert periodic.strongest([(4, 8, 2), (4, 16, 4)]) == (4, 8, 2)
    assert periodic.strongest([]) is None
    words = b"a b c a b c a b c a b c d".split()
    assert periodic.collapsed(words, periodic.runs(periodic.numbered(words))) == b"a b c d".split()


def test_very_long_texts():
    n = 300_000
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.runs(np.arange(n) % 70_000) == [(0, n, 70_000)]
    assert periodic.runs(np.arange(n)) == []
    assert len(periodic.runs(np.arange(n) // 6 % 1000)) == n // 6 + 1


def test_odd_rows_and_clashing_columns(spark, odd, none):
    rows = [(None, "x " * 9), (1, "a b " * 6 + " "), (2, "\x1c " * 7), (3, None), (3, ""), (4, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs_", F.lit("mine")).withColumn("start", F.lit(1))
    got = periodic.periodic_runs(docs).collect()
    assert [len(r["runs_"]) for r in got] == [1, 1, 1, 0, 0, 0]
    assert [r["collapsed_"] for r in got] == ["x", "a b  ", "\x1c", "", "", "one"] and got[0]["start"] == 1
    assert got[1]["strongest_"].asDict() == {"start": 0, "length": 12, "period": 2} and got[4]["strongest_"] is None
    assert periodic.periodic_runs(odd).count() == 8 and periodic.periodic_runs(none).collect() == []
