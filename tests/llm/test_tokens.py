import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ductwise.llm import packing, tokenfile
from ductwise.llm.common import CachedTokenizer

ODDITIES = ["it's 's x''s don't'll  a  b\n\n c", "  lead", "trail  ", "½ ² Ⅷ ŕa aŕ éx", "a b 　 c", "ßẞ İI <|endoftext|>", "'a ''b", "\x1c\x1d a", "日本語 ñandú", "A'S IT'S", "\r\n\t x", "x   \n"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_ids_are_the_librarys(documents, name, kind):
    t, library = CachedTokenizer(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
    for text in ODDITIES + [r["text"] for r in documents.collect()]:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.encode(r)
        assert len(control) == -(-n // 4)
        assert (tokenfile.decode(control, data, n) == r).all()
    assert [len(tokenfile.encode(np.array([x]))[1]) for x in (0, 255, 256, 65535, 65536, 2**24)] == [1, 1, 2, 2, 3, 4]


def plain(documents, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), key=lambda r: (r[0], r[1]))
    return [(d, [*t.encode(x, add_special_tokens=False).ids, end]) for d, x in rows]


def special(spark):
    return spark.createDataFrame(list(enumerate(ODDITIES)), "doc_id long, text string")


def test_token_file(spark, documents, odd, none):
    for docs in (documents, odd, special(spark)):
        want, at = [], 0
        for d, ids in plain(docs, "byte_bpe_50k.json", 2):
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = tokenfile.round_trip(docs, "/opt/tokenizers/byte_bpe_50k.json", 2).collect()
        assert sorted(map(tuple, got)) == want
    assert tokenfile.round_trip(none, "/opt/tokenizers/byte_bpe_50k.json", 2).collect() == []


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    return len(bins), packing.lower_bound(counts, capacity)


def test_documents_are_packed(spark, documents, odd, none):
    for docs in (documents, odd, special(spark)):
        rows = packing.pack_documents(docs, "/opt/tokenizers/word_bpe_49k.json", 2048, 0).collect()
        used, least = check_packing(rows, 2048)
        assert used == least
        want = []
        for d, ids in plain(docs, "word_bpe_49k.json", 0):
            for i, at in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[at : at + 2048], "<u4").tobytes()
                want.append((d, i, at, len(part) // 4, zlib.crc32(part)))
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.pack_documents(none, "/opt/tokenizers/word_bpe_49k.json").collect() == []


def fewest(sizes, capacity):
    """Least number of bins by trying all ways."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(120):
        sizes = sorted(rng.integers(3, 30, 10).tolist(), reverse=True)
        counts = {s: sizes.count(s) for s in set(sizes)}
        found = packing.plan(counts, 40)
        items = sorted((s for group, n in found for s in group * n), reverse=True)
        assert items == sizes
        assert all(sum(g) <= 40 for g, _ in found)
        assert sum(n for _, n in found) == fewest(sizes, 40)


def test_very_many_equal_pieces(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 900 + 1).cast("long").alias("length"), F.lit("x").alias("at"))
    used, least = check_packing(packing.pack(rows, 2048).collect(), 2048)
    assert used == least
