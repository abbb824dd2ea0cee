import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ductwise.llm import langid, maxent, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert sum(held) >= 0.98 * len(held)
    got = {r["doc_id"]: r for r in langid.identify(odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert langid.identify(none).collect() == []


def test_backoff_reads_unseen_words(spark):
    rows = [(i, "weather " * 3 + "Wetter", "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame(rows + [(100 + i, "wunderbarkeit freundlichkeit", "de") for i in range(20)] + [(200 + i, "wonderfulness", "en") for i in range(20)], "doc_id long, text string, lang string")
    scorer = langid.Scorer(langid.fit(docs))
    assert scorer.predict("heiterkeit")[0] == "de" and scorer.predict("happiness")[0] == "en" and scorer.predict("42 %")[0] == "und"


def test_toxic_documents_are_found(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit(docs.where("doc_id % 3 <> 0"), labels, toxicity.CATEGORIES)
    got = toxicity.score(docs, chain).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    hit = sum(r["is_toxic"] and r["toxic"] for r in got)
    assert hit >= 0.85 * sum(r["toxic"] for r in got)  # some labels have nothing in the text to go by
    assert hit >= 0.9 * sum(r["is_toxic"] for r in got)
    assert all(0 <= r["p_toxic"] <= 1 for r in got)
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == 8 and not any(r["is_toxic"] for r in rows)
    assert toxicity.score(none, chain).collect() == []
    blank = toxicity.fit(none, labels, toxicity.CATEGORIES)
    assert not any(r["is_toxic"] for r in toxicity.score(odd, blank).collect())
    kept = toxicity.keep_clean(odd.withColumn("toxic", F.lit(1)), labels)
    assert kept.columns == [*odd.columns, "toxic"]


def test_a_later_model_uses_the_earlier_one():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400).astype(float)
    x = toxicity.Rows.of_lists([np.array([0]) for _ in y], 1)
    b, w, d = toxicity.fit_linear(x, np.column_stack([2 * y - 1]), y, np.ones(400, bool))
    p = toxicity._sigmoid(x.dot(w) + np.column_stack([2 * y - 1]) @ d + b)
    assert ((p > 0.5) == (y > 0.5)).all()


def plain_tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_scores_and_model(spark, documents, odd, none):
    for docs, most in ((documents, 1 << 17), (documents, 300), (odd, 5)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        train = Counter(t for d, x in rows if zlib.crc32(str(d).encode()) % 5 != 1 for t in plain_tokens(x))
        total, distinct = sum(train.values()), len(train)
        want = sorted((d, zlib.crc32(str(d).encode()) % 5 == 1, len(plain_tokens(x)), sum(train[t] > 0 for t in plain_tokens(x)), total, sum(math.log10((train[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in plain_tokens(x))) for d, x in rows)
        got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in maxent.score(docs, max_words=most).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert maxent.score(none).collect() == []


def test_model_beats_the_base_on_held_out_text(spark):
    rows = maxent.score(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one():
    v = maxent.Vocabulary.of([(b"", 4), (b"a", 9), (b"bb", 3), *((f"w{i}".encode(), 2) for i in range(400))], 900, 500)
    weights = np.random.default_rng(1).normal(size=(2 * maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    keys = np.repeat(maxent.features(np.array([1, 2, 0]), np.array([3])), maxent.LEAVES, 0)
    leaf = np.tile(np.arange(maxent.LEAVES), 3)
    logs = maxent.token_logs(weights, keys, leaf // maxent.CLASSES, leaf % maxent.CLASSES, v.priors())
    assert np.allclose(np.exp(logs).reshape(3, -1).sum(1), 1, rtol=1e-5)
    per_leaf = np.bincount(v.leaves, 10 ** v.in_leaf()[:-1], maxent.LEAVES)
    assert np.allclose(per_leaf[per_leaf > 0], 1)


def plain_model(texts, train, total, most, weights):
    """The model's log10 probability of each text, token by token."""
    level = next(k for k in range(1, total + 2) if sum(c >= k for c in train.values()) <= most)
    top = sorted(((w, c) for w, c in train.items() if w is not None and c >= level), key=lambda x: (-x[1], x[0].encode()))
    ids = {None: 0} | {w: i for i, (w, _) in enumerate(top, 1)}
    count = [train[None], *(c for _, c in top)]
    leaf = [0, *(i if i <= 200 else 201 + (w.encode()[0] * 7 + w.encode()[-1]) % 54 for i, (w, _) in enumerate(top, 1)), 255]
    mass, smooth = np.full(256, 0.5), np.zeros(256)
    for x, c in zip(leaf, [*count, total - sum(count)], strict=True):
        mass[x] += c
    for x, c in zip(leaf, count, strict=False):
        smooth[x] += c + 0.5
    unknown = total - sum(count) + 0.5 * (len(train) - sum(c > 0 for c in count) + 1)
    mass = mass.reshape(16, 16)

    def factor(keys, table, prior, y):
        z = np.log(prior / prior.sum()) + sum(table[(k * 0x9E3779B97F4A7C15 % 2**64) >> 49].astype(float) for k in keys)
        return (z[y] - np.log(np.exp(z).sum())) / math.log(10)

    out = []
    for words in texts:
        x, logs = [ids.get(w, len(count)) for w in words], 0.0
        for i, w in enumerate(words):
            a, b = (x[i - 1] + 1 if i else 0), (x[i - 2] + 1 if i > 1 else 0)
            keys, (c, m) = (3 * a + 1, 3 * b + 2, 3 * ((a << 20) + b)), divmod(leaf[x[i]], 16)
            logs += factor(keys, weights[: 1 << 15], mass.sum(1), c) + factor([k + ((c + 1) << 42) for k in keys], weights[1 << 15 :], mass[c], m)
            logs += math.log10((train[w] + 0.5) / (unknown if x[i] == len(count) else smooth[leaf[x[i]]]))
        out.append(logs)
    return out


def test_model_scores_by_brute_force(spark, documents, odd, monkeypatch):
    weights = np.random.default_rng(3).normal(size=(2 * maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    monkeypatch.setattr(maxent, "train", lambda *_: weights)
    for docs, most in ((documents.where("length(text) < 3000"), 1 << 17), (documents.where("length(text) < 3000"), 400), (odd, 3)):
        rows = [(r["doc_id"], plain_tokens(r["text"])) for r in docs.collect()]
        train = Counter(t for d, x in rows if zlib.crc32(str(d).encode()) % 5 != 1 for t in x)
        want = sorted(zip((d for d, _ in rows), plain_model([x for _, x in rows], train, sum(train.values()), most, weights), strict=True))
        got = sorted((r["doc_id"], r["score"]) for r in maxent.score(docs, max_words=most).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5)
