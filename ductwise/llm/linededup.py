"""Removal of passages that an earlier document holds: winnowing, joined positions, matches extended both ways.

Repeated passages rarely begin or end with a line, so the hashed unit is a window of K words rather than a whole line, with
line breaks read as any white space. Of every WINDOW neighbouring hashes the smallest is a fingerprint, so a run of
K + WINDOW - 1 = 50 words that two documents share has a fingerprint that both select. Around each fingerprint that different
texts share, the match is extended both ways: all windows of 50 words that hold the fingerprint are hashed, and a window whose
hash an earlier document has too is a repeat. The union of those is exactly what goes.

Both times a hash is looked for in "an earlier document", never in all others: of the documents of one batch only the first
with a hash takes part in the shuffle, and the others are known to be later. So a passage in a third of all documents sends one
row for each batch and hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ductwise.llm.common import saved, scratch, stored, to_bytes, unused

K, WINDOW = 26, 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = to_bytes(text).split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of every k neighbouring words, from prefix sums of a polynomial modulo 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(h))
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    x = (p[k:] - p[:n]) * down[:n]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def winnow(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the minima of all windows; of equal minima the last, and the one before stays while it is among them."""
    if not len(x):
        return np.zeros(0, np.int64)
    if len(x) <= window:
        return np.array([len(x) - 1 - int(np.argmin(x[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(x, window)
    at = np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)
    at = at[np.append(True, at[1:] != at[:-1])]
    value, out, last = x[at], [int(at[0])], 0
    if (value[1:] != value[:-1]).all():
        return at
    for i in range(1, len(at)):  # equal neighbours: skip while the kept one is in reach of the next window
        if value[i] == value[last] and i + 1 < len(at) and at[i + 1] - out[-1] < window:
            continue
        out.append(int(at[i]))
        last = i
    return np.array(out)


#: Hashed places that are brought together at once.
_PLACES = 1 << 21


def _first_holders(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, alone): which places belong to the first document with their key, and which keys no other document has."""
    at = np.lexsort((order, keys))
    k, o = keys[at], order[at]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    first, alone = np.zeros(len(k), bool), np.zeros(len(k), bool)
    first[at] = o == np.repeat(o[start], size)
    alone[at] = np.repeat(o[start] == np.maximum.reduceat(o, start) if len(k) else o[start], size)
    return first, alone


def _ranks(doc_id: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """Places of rows in the order of (doc_id, tx); equal rows have one place."""
    at = np.lexsort((tx, doc_id))
    out = np.empty(len(at), np.int64)
    d, t = doc_id[at], tx[at]
    out[at] = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))[: len(at)] if len(at) else []
    return out


def _split(values: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(n)[:-1]) if len(n) else []


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document: its number of words, fingerprints that may be the first of their kind, and places of those that other texts of the batch have."""
    for b in batches:
        doc, tx = b["doc_id"].to_numpy(), b["tx"].to_numpy()
        rank = _ranks(doc, tx)
        one = pd.Series(rank).groupby(tx).transform("min").to_numpy() == rank  # of copies the first speaks for all
        pos, h, n_words = [], [], []
        for text, wanted in zip(b["text"], one, strict=True):
            w = word_hashes(text)
            x = window_hashes(w) if wanted else np.zeros(0, np.uint64)
            at = winnow(x)
            pos.append(at)
            h.append(x[at])
            n_words.append(len(w))
        n = np.array([len(x) for x in pos], np.int64)
        of = np.repeat(np.arange(len(b)), n)
        h, pos = np.concatenate([*h, np.zeros(0, np.uint64)]).view(np.int64), np.concatenate([*pos, np.zeros(0, np.int64)]).astype(np.int32)
        first, alone = _first_holders(h, rank[of])
        count = lambda mask: np.bincount(of[mask], minlength=len(b))
        yield pd.DataFrame({"doc_id": doc, "tx": tx, "n": np.array(n_words, np.int32), "h": _split(h[first], count(first)), "pos": _split(pos[first], count(first)), "shared": _split(pos[~alone], count(~alone))})


def _windows(least: int):
    """For each document: the windows of `least` words around shared fingerprints that may be the first of their kind, and where those begin that an earlier document of the batch has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(part: pd.DataFrame, keys: list[np.ndarray], at: list[np.ndarray]) -> pd.DataFrame:
            doc, tx, n = part["doc_id"].to_numpy(), part["tx"].to_numpy(), np.array([len(x) for x in at], np.int64)
            of, key, start = np.repeat(np.arange(len(part)), n), np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32)
            first, _ = _first_holders(key, _ranks(doc, tx)[of])
            count = lambda mask: np.bincount(of[mask], minlength=len(part))
            return pd.DataFrame({"doc_id": doc, "tx": tx, "key": _split(key[first], count(first)), "start": _split(start[first], count(first)), "later": _split(start[~first], count(~first))})

        for b in batches:
            keys, at, begin, held = [], [], 0, 0
            for i, (text, places) in enumerate(zip(b["text"], b["places"], strict=True)):
                y = window_hashes(word_hashes(text), least)
                near = np.zeros(len(y) + 1, np.int64)
                p = np.asarray(places, np.int64)
                np.add.at(near, np.clip(p - (least - K), 0, len(y)), 1)
                np.add.at(near, np.clip(p + 1, 0, len(y)), -1)
                at.append(np.flatnonzero(np.cumsum(near[:-1])))
                keys.append(y[at[-1]])
                held += len(keys[-1])
                if held > _PLACES:
                    yield out(b.iloc[begin : i + 1], keys, at)
                    keys, at, begin, held = [], [], i + 1, 0
            if at:
                yield out(b.iloc[begin:], keys, at)

    return run


def cut(text: str, starts: np.ndarray, least: int) -> tuple[str, int]:
    """The text without the `least` words from each start on (all words if that is -1), and how many words those were."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    inside = np.zeros(len(words) + 1, np.int64)
    if len(starts) and starts[0] < 0:
        inside[0] = 1
    else:
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(starts + least, len(words)), -1)
    keep, gone, at = np.cumsum(inside[:-1]) == 0, 0, 0
    if keep.all():
        return text, 0
    lens = np.fromiter(map(len, words), np.int64, len(words))
    blank = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    out, edge = [], np.flatnonzero(np.diff(np.concatenate([[1], keep.astype(np.int8), [1]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else int(starts[-1] + lens[-1])
        gone += int(b - a)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), gone


def _is_later(first: Column) -> Column:
    return (F.col("doc_id") > first["doc_id"]) | ((F.col("doc_id") == first["doc_id"]) & (F.col("tx") > first["tx"]))


def repeats(docs: DataFrame, least: int = K + WINDOW - 1) -> DataFrame:
    """(doc_id, tx, starts) of documents with words that go: where the repeated windows of `least` words begin, or [-1] for all words.

    A window is a repeat if an earlier document holds it; documents are in order of (doc_id, tx), tx being the hash of the
    text, so rows that share an id but not a text are different documents and equal rows are one. Copies of a whole text
    meet by tx alone. Windows are hashed from the text again, each word by all 64 bits of its hash.
    """
    if least < K + WINDOW - 1:
        raise ValueError(f"winnowing guarantees runs of {K + WINDOW - 1} words and more")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tx"), "text")
    with scratch(docs.sparkSession) as path:
        rows = stored(texts.mapInPandas(_fingerprints, "doc_id long, tx long, n int, h array<long>, pos array<int>, shared array<int>"), f"{path}/prints")
        copied = rows.groupBy("tx").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n")).where("first < last").select("tx", "first", "n")
        copied = stored(copied, f"{path}/copied")
        by_print = W.partitionBy("h")
        open_ = rows.select("doc_id", "tx", F.inline(F.arrays_zip("h", "pos")))
        open_ = open_.withColumn("low", F.min("tx").over(by_print)).withColumn("high", F.max("tx").over(by_print)).where("low <> high")
        places = open_.select("doc_id", "tx", "pos").unionByName(rows.select("doc_id", "tx", F.explode("shared").alias("pos")))
        places = places.groupBy("doc_id", "tx").agg(F.collect_set("pos").alias("places"))
        places = places.join(copied.select("tx", "first"), "tx", "left").where("first is null or first = doc_id").drop("first")
        found = texts.join(places, ["doc_id", "tx"])
        found = stored(found.mapInPandas(_windows(least), "doc_id long, tx long, key array<long>, start array<int>, later array<int>"), f"{path}/windows")
        first = F.min(F.struct("doc_id", "tx")).over(W.partitionBy("key"))
        again = found.select("doc_id", "tx", F.inline(F.arrays_zip("key", "start"))).withColumn("first", first).where(_is_later(F.col("first")))
        starts = again.select("doc_id", "tx", "start").unionByName(found.select("doc_id", "tx", F.explode("later").alias("start"))).groupBy("doc_id", "tx").agg(F.collect_list("start").alias("starts"))
        copies = rows.select("doc_id", "tx").join(copied, "tx").where(f"doc_id > first and n >= {least}").select("doc_id", "tx", F.array(F.lit(-1)).alias("starts"))
        return saved(starts.unionByName(copies.distinct()))


def remove_repeats(docs: DataFrame, least: int = K + WINDOW - 1, removed: str | None = None) -> DataFrame:
    """`docs` with every run of at least `least` words that an earlier document holds taken out of `text`.

    All rows and columns stay; `removed` names a column to add with the number of words taken. The first document with a
    passage, by (doc_id, text hash), keeps it. A word goes if it is in a run of `least` words or more that one earlier document
    holds as one run. Null texts, null ids, empty texts and texts under `least` words stay as they are; a document that is
    a copy of an earlier one is left with an empty text, or its white space. Repeats inside one document are not touched.
    """
    add = [removed] if removed else []
    doc, tx, starts = unused(docs, "doc", "tx", "starts")
    found = repeats(docs.select("doc_id", "text"), least).toDF(doc, tx, starts)
    joined = docs.join(found, (docs["doc_id"] == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tx)), "left").select(*[docs[c] for c in docs.columns], starts)
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, texts = b.column(b.num_columns - 1), b.column(place)
            new, gone = texts.to_pylist(), [0] * b.num_rows
            for i in np.flatnonzero(begin.is_valid().to_numpy(zero_copy_only=False)):
                new[i], gone[i] = cut(new[i], begin[i].values.to_numpy(), least)
            columns = [pa.array(new, texts.type) if k == place else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(gone, pa.int32())] if add else [])], names=[*b.schema.names[:-1], *add])

    return joined.mapInArrow(run, StructType([*schema.fields, *(StructField(c, IntegerType()) for c in add)]))
