import random

import pytest

from ductwise.llm import simhash


def jaccard(a, b):
    x, y = (set(simhash.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def pairs(rng, low, high, n):
    """Pairs of texts whose similarity lies between low and high, words replaced at even distances."""
    out = []
    while len(out) < n:
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rng.randrange(100, 400))]
        other = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(1, len(words) // 8)):
            other[at] = "x" + other[at]
        if low <= jaccard(" ".join(words), " ".join(other)) < high:
            out.append((" ".join(words), " ".join(other)))
    return out


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.keep_first(docs).collect()}


@pytest.mark.parametrize("group", [4096, 8])
def test_recall_and_false_links(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(5)
    alike, other = pairs(rng, 0.8, 0.85, 300), pairs(rng, 0.6, 0.75, 300)
    got = kept(spark, [t for p in alike + other for t in p])
    missed = sum(2 * i + 1 in got for i in range(300))
    assert missed <= 3
    assert all({2 * i, 2 * i + 1} <= got for i in range(300, 600))


@pytest.mark.parametrize("group", [4096, 8])
def test_a_template_with_different_fillings_stays_and_copies_of_one_go(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(6)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))

    frame = words(150)
    texts = [f"{frame} {words(35)}" for _ in range(40)]
    assert all(jaccard(a, b) < 0.75 for i, a in enumerate(texts) for b in texts[:i])
    copies = [f"{texts[0]} {words(n)}" for n in range(1, 20)]
    assert kept(spark, texts + copies) == set(range(40))


def test_one_fingerprint_is_not_one_text(spark):
    same = " ".join(["a b c d e"] * 300)
    texts = [f"{same} one two three four five", f"{same} six seven eight nine ten"]
    assert simhash.fingerprint(texts[0], 5, 2) == simhash.fingerprint(texts[1], 5, 2) and jaccard(*texts) < 0.5
    assert kept(spark, texts) == {0, 1}


def test_rows_with_a_null_doc_id_stay(spark):
    rows = [(None, "only here"), (1, "one two three four five"), (2, "one two three four five"), (None, "one two three four five"), (None, None)]
    out = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [rows[0], rows[1], rows[3], rows[4]]))
