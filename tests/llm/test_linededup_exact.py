import random

import xxhash
from test_linededup import passage, run

from ductwise.llm import linededup


def plain(docs, least=50):
    """What stays of each document's words when every run of `least` words that one earlier document holds goes; docs are in order, texts different."""
    seen, out = set(), {}
    for doc_id, text in docs:
        w = [x.decode() for x in text.encode().split()]
        windows = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        gone = {i + k for i, x in enumerate(windows) if x in seen for k in range(least)}
        seen |= set(windows)
        out[doc_id] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_documents_as_brute_force(documents):
    """Neither too much nor too little goes; copies of a whole text of under 50 words stay."""
    order = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), key=lambda r: r[0])
    want = plain(order)
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(documents).collect()}
    assert {d: [x.decode() for x in t.encode().split()] for d, t in got.items()} == want


def test_words_whose_hashes_begin_alike_are_different(spark):
    first, pair = {}, None
    for i in range(5000):
        w = f"w{i}"
        other = first.setdefault(xxhash.xxh64_intdigest(w.encode()) >> 48, w)
        if other != w:
            pair = other, w
            break
    assert pair
    words = passage(random.Random(5), 60).split()
    texts = [" ".join([*words[:30], x, *words[31:]]) for x in pair]
    assert run(spark, texts) == {0: (texts[0], 0), 1: (texts[1], 0)}
