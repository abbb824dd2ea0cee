import random
import re

import xxhash
from pyspark.sql import functions as F

from ductwise.llm import simhash
from ductwise.llm.components import components


def plain_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= distance:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in fps}


def check(rows, texts):
    fps = [(d, plain_fingerprint(t)) for d, t in texts]
    assert {r["doc_id"]: r["f0"] % 2**64 for r in rows} == dict(fps)
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(fps)


def test_documents_as_brute_force(documents):
    rows = simhash.near_duplicates(documents).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_a_dense_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(f & (2**64 - 1) for f in fps)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    for blocks in (6, 8):
        edges = simhash.links(spark.createDataFrame(signed, "f0 long").withColumn("node", F.col("f0")), 4, blocks)
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(edges).collect()}
        want = plain_components([(f, f) for f in fps])
        groups = {}
        for f, r in want.items():
            groups.setdefault(r, set()).add(f)
        mine = {}
        for f, r in got.items():
            mine.setdefault(r, set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_odd_rows_and_clashing_columns(odd, none):
    rows = simhash.near_duplicates(odd.withColumn("f0", F.lit("x")).withColumn("component_id", F.lit(1))).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["f0"] == by[1]["f0"] == by[2]["f0"] == 0 and by[2]["component_id"] == 0
    assert by[6]["component_id"] == by[5]["component_id"] == 4
    assert simhash.near_duplicates(none).collect() == []
    assert sorted(r["doc_id"] for r in simhash.keep_first(odd).collect()) == [0, 3, 4]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 300))]
        texts.append(" ".join(words))
        for edits in (0, 1, 2):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert {4 * i for i in range(60)} <= kept and len(kept) <= 66
