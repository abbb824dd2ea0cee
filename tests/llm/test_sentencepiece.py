import random
import zlib

import numpy as np
import sentencepiece as library

from ductwise.llm import sentencepiece as own

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODDITIES = ["a  b\n c d 日é x", " lead trail ", "     ", "\t", "x" * 300 + " " + "ab" * 40, "😀 emojí", "ÀÉ ñandú", "a" * 47 + " " + "b" * 49, "▁ mark"]


def plain(texts):
    sp = library.SentencePieceProcessor(model_file=MODEL)
    return {i: sp.encode(t or "") for i, t in texts}


def check(spark, rows, most):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    got = own.encode(docs, own.Pieces.load(MODEL), most).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == want
    ends = {r["doc_id"]: r for r in own.round_trip(docs, MODEL, most).collect()}
    for i, t in rows:
        assert ends[i]["n_ids"] == len(want[i]) and ends[i]["ids_crc32"] == zlib.crc32(np.array(want[i], "<u4").tobytes())
        assert ends[i]["returns"] == ("▁" not in (t or ""))


def test_the_librarys_ids_and_back(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODDITIES)] + [(100, None), (101, "")] + [(1000 + r["doc_id"], r["text"]) for r in documents.limit(60).collect()]
    check(spark, rows, 1 << 17)
    check(spark, rows[:40], 20)


def test_heap_merges_as_the_library():
    pieces, rng = own.Pieces.load(MODEL), random.Random(3)
    sp = library.SentencePieceProcessor(model_file=MODEL)
    for _ in range(300):
        word = "".join(rng.choice("aeinorstlhd,.é日") for _ in range(rng.randrange(1, 70)))
        assert [i for u in own.units(word) for i in pieces.merge(u.replace(" ", own.SPACE))] == sp.encode(word)


def test_empty(none):
    assert own.round_trip(none, MODEL).collect() == []


def test_round_trip_holds_texts_in_one_worker(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    plan = own.round_trip(docs, MODEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_rare_words_are_merged_by_their_parts(monkeypatch):
    pieces, merged = own.Pieces.load(MODEL), []
    sp = library.SentencePieceProcessor(model_file=MODEL)
    assert pieces.parts(" under.\nZwölf,") == [" under", ".\n", "Zwölf", ","]
    words = [f" qu{a}xorn{s}{b.title()}{t}" for a in "aeiou" for b in ("zend", "mórth") for s in (".\n", "***", "-") for t in ("", "!", "日", "()")]
    before = own.Pieces.merged
    monkeypatch.setattr(own.Pieces, "merged", lambda self, part: merged.append(part) or before(self, part))
    rare = own._Parts(pieces, {})
    assert [np.frombuffer(b"".join(map(rare.__getitem__, pieces.parts(w))), "<u4").tolist() for w in words] == [sp.encode(w[1:]) for w in words]
    assert len(words) == 120 and len(merged) == len(set(merged)) <= 5 + 2 + 3 + 3


def test_short_parts_are_merged_as_by_the_heap(monkeypatch):
    pieces, rng = own.Pieces.load(MODEL), random.Random(5)
    parts = ["".join(rng.choice(" aeinorstlhdcgm.é日") for _ in range(rng.randrange(0, 70))) for _ in range(500)]
    heap = own.Pieces._heap
    monkeypatch.setattr(own.Pieces, "_heap", lambda self, part: heap(self, part) if len(part) > own.SCAN else None)
    short = [pieces.merged(p) for p in parts]
    monkeypatch.undo()
    monkeypatch.setattr(own, "SCAN", -1)
    assert short == [pieces.merged(p) for p in parts]
