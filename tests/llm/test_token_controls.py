import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ductwise.llm import packing, tokenfile
from ductwise.llm.common import CachedTokenizer

#: All of ASCII with its controls, more of what ends a pre-token, and some beyond it.
POOL = [*map(chr, range(128)), *"   \n\t..,!?';:-" * 3, *"abcdeABC019" * 4, *"\x80\x85\xa0éßİ̀　中​ ﻿😀½Ⅷ"]


def texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        t = "".join(rng.choice(POOL) for _ in range(rng.randrange(1, 14)))
        yield f"end{rng.choice('.?!,;)-')}{chr(rng.choice([*range(32), 127]))}{t}" if k % 3 == 0 else t


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_random_texts_with_controls(name, kind):
    mine, library = CachedTokenizer(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
    for t in ["end.\x7f next", "?\x00", *texts(20_000, 3)]:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packed_and_filed_ids_of_such_texts(spark):
    rows = list(enumerate(["end.\x7f next", "?\x00", *texts(400, 9)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, end, found in (
        ("word_bpe_49k.json", 0, packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)),
        ("byte_bpe_50k.json", 2, tokenfile.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)),
    ):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = {d: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in rows}
        assert {r["doc_id"]: r["ids_crc32"] for r in found.collect()} == want
