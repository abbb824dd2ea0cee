import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ductwise.llm import vectorcodes
from ductwise.llm.queries import _OP12, op12_vector_codes
from tests.llm.conftest import DATA


def test_search_keeps_the_lower_index_of_ties():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 200):
        entries = rng.integers(-6, 6, (n, 3))
        x = rng.integers(-8, 8, (700, 3))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        index, best = vectorcodes.nearest(entries, vectorcodes.Box.around(entries), x)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def plain(rows, parts=16, entries=64, rounds=2):
    """(code, error, label) of each usable row and the digest, by comparing with every entry."""
    ok = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not ok:
        return [], ""
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for _, v, _ in ok]).reshape(len(ok), parts, -1)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, x[i].reshape(-1).tolist()))[:entries]
    books = [x[order, p].copy() for p in range(parts)]

    def assign():
        far = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return [f.argmin(1) for f in far], sum(f.min(1) for f in far)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[code[p] == e, p]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    code, error = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    labels = {}
    for (_, _, label), e in zip(ok, error.tolist(), strict=True):
        labels[label] = labels.get(label, 0) + e
    return [(k, "".join(f"{int(c[i]):02x}" for c in code), int(error[i]), labels[label]) for i, (k, _, label) in enumerate(ok)], digest


def same(frame, rows):
    want, digest = plain(rows)
    got = frame.collect()
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == sorted(want, key=repr)


def test_embeddings_as_brute_force_and_sql(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    found = op12_vector_codes(spark, DATA)
    same(found, rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(con.execute(f"select {', '.join(names)} from ({_OP12})").fetchall()) == sorted(map(tuple, found.select(names).collect()))


def odd():
    rng = np.random.default_rng(1)
    rows = [(i // 2 if i else None, rng.integers(-3, 3, 16).astype(float).tolist(), None if i % 3 == 0 else i % 2) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + [1.0] * 15, 1), (202, [float("nan")] * 16, 2), (203, [float("inf")] + [0.0] * 15, 2), rows[5], rows[5]]
    return rows


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in (odd(), odd()[:7], odd()[-6:-2], []):
        frame = spark.createDataFrame(rows, schema).withColumn("key", F.lit("x")).withColumn("code", F.lit(1)).withColumn("tag", F.lit(2))
        same(vectorcodes.compress(frame, "vec_id", "embedding", "label"), rows)
    with pytest.raises(ValueError, match="one length"):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], schema), "vec_id", "embedding", "label")


def test_frequent_labels_are_not_gathered(spark, monkeypatch):
    from ductwise.llm import common

    monkeypatch.setattr(common.joined_by, "__defaults__", (20,))
    rows = odd()
    same(vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label"), rows)
