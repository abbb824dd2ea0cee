import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ductwise.llm import minhash
from ductwise.llm.queries import op11_minhash
from tests.llm.conftest import DATA


def plain(docs, percent, width):
    """(n_shingles, component_id) of each row by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def same(frame, docs, percent=85, width=3):
    rows = frame.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr) == plain(docs, percent, width)


def test_documents_as_brute_force(spark, documents):
    same(op11_minhash(spark, DATA), [(r["doc_id"], r["text"]) for r in documents.collect()])


def near(n, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 90))]
        for _ in range(rng.randrange(1, 7)):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(words).title() if rng.random() < 0.3 else "\n".join(words)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [60, 85])
def test_pairs_about_the_threshold(spark, percent):
    docs = near(60)
    same(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent, 3), docs, percent)


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for family in range(3):  # families that are close to each other, but under the threshold
        own = [f"{x}f{family}" if i % 4 == 0 and i < 8 * family else x for i, x in enumerate(base)]
        for _ in range(60):
            words = list(own)
            words[rng.randrange(60)] = f"x{rng.randrange(5)}"
            docs.append((len(docs), " ".join(words)))
    same(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85, 3), docs)


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("node", F.lit("x")).withColumn("size", F.lit(1)).withColumn("component_id", F.lit(7))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same(minhash.near_duplicates(clash, 85, 3), docs)
    assert minhash.near_duplicates(none, 85, 3).collect() == []
    docs = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "e"), (4, "E"), (None, "alone here now"), (None, None), (9, "z " * 30000)]
    same(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85, 3), docs)


def test_signatures_are_those_of_the_set_alone():
    """Early stopping and batches change nothing, and the estimate is right with less spread than independent registers have."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 10, 100, 3000)]
    together = minhash.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert (minhash.signatures([rng.permutation(s)])[0] == row).all()
    off = []
    for _ in range(300):
        n = int(rng.integers(60, 500))
        both = round(2 * n * 0.85 / 1.85)
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = minhash.signatures([x[:n], x[n - both :]])
        off.append((a == b).mean() - both / (2 * n - both))
    assert abs(np.mean(off)) < 0.006
    assert np.std(off) < 0.95 * np.sqrt(0.85 * 0.15 / minhash.REGISTERS)
