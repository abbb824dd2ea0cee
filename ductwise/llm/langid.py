"""Language identification: known words first, backing off to ever shorter character n-grams for unseen words.

A word that was seen in training scores by its log frequency in each language. An unseen word is read letter by letter: at
each place the longest known n-gram that starts there, five letters at most with the word's edges marked, gives its log
frequency; the word scores the mean over its places. A text scores the sum of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import smallest_hashes

UNKNOWN = "und"
LONGEST = 5
_WORD = re.compile(r"[^\W\d_]+")
#: Vectors of unseen words that a Python worker keeps.
_REMEMBERED = 200_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray


def _grams(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    for at in range(len(marked)):
        for n in range(1, min(LONGEST, len(marked) - at) + 1):
            yield marked[at : at + n]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            counts.update((lang, w) for w in _WORD.findall(text.lower()))
        if len(counts) > 500_000:
            yield _frame(counts)
            counts = Counter()
    yield _frame(counts)


def _frame(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "item", "n"])


def _to_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(b["lang"], b["item"], b["n"], strict=True):
            for g in _grams(word):
                counts[lang, g] += n
        yield _frame(counts)


def _table(counted: DataFrame, langs: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """The `most` frequent items and log frequencies by language, smoothed by a half."""
    own = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    rows = counted.groupBy("item").agg(F.sum("n").alias("n"), *own).orderBy(F.desc("n"), "item").limit(most).toPandas()
    counts = rows[[f"n{i}" for i in range(len(langs))]].to_numpy(np.float64).reshape(len(rows), len(langs))
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (len(rows) + 1)))
    return {w: i for i, w in enumerate(rows["item"])}, logs


def fit(docs: DataFrame, max_docs: int = 6000, max_words: int = 200_000, max_grams: int = 200_000) -> Model:
    """Learns from text and lang of at most max_docs rows that have both: those with the smallest hash of doc_id.

    The model has the max_words most frequent words and the max_grams most frequent n-grams, rarer ones back off to shorter
    n-grams: the bounds keep the model, which every executor gets, under 100 MB whatever the corpus. Words seen once are left to
    the n-grams. No rows give a model that knows no language.
    """
    chosen = smallest_hashes(docs.where("lang is not null and text is not null").select("doc_id"), "doc_id", max_docs).distinct()
    sample = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    counted = sample.select("lang", "text").mapInPandas(_count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")).cache()
    try:
        langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
        if not langs:
            return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
        words, word_logs = _table(counted.where("n > 1"), langs, max_words)
        grams, gram_logs = _table(counted.mapInPandas(_to_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), langs, max_grams)
    finally:
        counted.unpersist()
    return Model(langs, words, grams, word_logs, gram_logs)


class Scorer:
    """Rows of word vectors, known ones first and then remembered unseen ones."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at = dict(self.model.words)
        self.known = len(self.at)
        self.logs = np.concatenate([self.model.word_logs.reshape(self.known, len(self.model.langs)), np.zeros((4096, len(self.model.langs)))])

    def unseen(self, word: str) -> np.ndarray:
        marked, grams, out = f"^{word}$", self.model.grams, np.zeros(len(self.model.langs))
        for at in range(len(marked)):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                found = grams.get(marked[at : at + n])
                if found is not None:
                    out += self.model.gram_logs[found]
                    break
        return out / len(marked)

    def row(self, word: str) -> int:
        if len(self.at) == len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[len(self.at)] = self.unseen(word)
        self.at[word] = len(self.at)
        return len(self.at) - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.at) > self.known + _REMEMBERED:
            self.reset()
        get, row = self.at.get, self.row
        rows = [i if (i := get(w)) is not None else row(w) for w in words]
        total = self.logs[rows].sum(0)
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is an input.

    `und` with score 0 if the text is null or has no letter. Equal scores go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": np.array([p for _, p in found], np.float64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, max_docs: int = 6000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows that are not held out, predicts all.

    Repeated rows are predicted each, an empty table gives no rows, other columns are not read.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), max_docs)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
