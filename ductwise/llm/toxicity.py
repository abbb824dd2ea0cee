"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each model sees the words of the text and what the earlier models say. In
training, "what the earlier models say" are out-of-fold predictions, so a later model learns how far to trust them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import saved, smallest_hashes

_WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word's beginning that are a feature of their own, for words that are longer.
STEM = 6
#: Words whose features a Python worker remembers.
_REMEMBERED = 300_000


def tokens(text: str | None) -> set[str]:
    """Different lower-case words of a whole text."""
    return set(_WORD.findall(text.lower())) if text else set()


def hashes(word: str) -> tuple[int, ...]:
    """Features of a word: itself and, if it is long, its beginning."""
    whole = zlib.crc32(word.encode("utf-8", "replace"))
    return (whole, zlib.crc32(f"^{word[:STEM]}".encode("utf-8", "replace"))) if len(word) > STEM else (whole,)


@dataclass
class Linear:
    category: str
    bias: float
    weights: np.ndarray
    earlier: np.ndarray
    threshold: float


@dataclass
class Chain:
    """features: hash of a word to its place. links: in the order of prediction."""

    features: dict[int, int]
    links: list[Linear]


class Rows:
    """Sparse 0/1 rows: place at[i] is set in row of[i]."""

    def __init__(self, at: np.ndarray, of: np.ndarray, n: int, width: int):
        self.at, self.of, self.n, self.width = at, of, n, width

    @classmethod
    def of_lists(cls, rows: list[np.ndarray], width: int) -> Rows:
        at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32)
        return cls(at, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.of], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float = 1.0, rounds: int = 120) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression with an L2 penalty by accelerated gradient steps over the rows of the mask `use`."""
    w, d, b = np.zeros(x.width), np.zeros(dense.shape[1]), 0.0
    share = np.clip(y[use].mean() if use.any() else 0.5, 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    moment = [np.zeros_like(w), np.zeros_like(d), 0.0]
    second = [np.zeros_like(w), np.zeros_like(d), 0.0]
    for t in range(1, rounds + 1):
        g = np.where(use, _sigmoid(x.dot(w) + dense @ d + b) - y, 0.0)
        grads = [x.back(g) + l2 * w, dense.T @ g + l2 * d, float(g.sum())]
        values = [w, d, b]
        for k, grad in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            values[k] = values[k] - 0.1 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        w, d, b = values
    return b, w, d


def _best_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """Of the out-of-fold probabilities, the cut with the best F1; half way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    last = np.append(p[order][1:] < p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.05, 0.95))


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = b.drop(columns=["text"])
        out["words"] = [np.unique(np.array([h for w in tokens(t) for h in hashes(w)], "<u4")).tobytes() for t in b["text"]]
        yield out


def _occurrences(names: list[str]):
    """How many rows have each hash, and of those in each category."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [np.frombuffer(w, "<u4") for w in b["words"]]
            h, at = np.unique(np.concatenate([*words, np.zeros(0, "<u4")]), return_inverse=True)
            of = np.repeat(np.arange(len(b)), [len(w) for w in words])
            yield pd.DataFrame({"h": h.astype(np.int64), "n": np.bincount(at, minlength=len(h)), **{f"one{k}": np.bincount(at, b[c].to_numpy(np.float64)[of], len(h)) for k, c in enumerate(names)}})

    return run


def _telling(rows: DataFrame, names: list[str], most: int, least_z: float) -> list[int]:
    """For each category the `most` hashes whose share differs most between its two classes, by least_z standard errors at least."""
    total, *ones = rows.agg(F.count("*"), *[F.sum(F.col(f"`{c}`")) for c in names]).first()
    counted = rows.mapInPandas(_occurrences(names), ", ".join(["h long, n long", *(f"one{k} double" for k in range(len(names)))]))
    counted = saved(counted.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"one{k}").alias(f"one{k}") for k in range(len(names))]).where("n > 1"))
    found: set[int] = set()
    for k, one in enumerate(ones):
        one, total = one or 0, max(total, 1)
        n1, n0 = max(one, 1), max(total - one, 1)
        p, both = F.col("n") / total, 1 / n1 + 1 / n0
        off = F.greatest(F.abs(F.col(f"one{k}") / n1 - (F.col("n") - F.col(f"one{k}")) / n0) - both, F.lit(0.0))  # less what one row more or less changes
        z = off / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * both)
        found |= {r["h"] for r in counted.select("h", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "h").limit(most).collect()}
    return sorted(found)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_docs: int = 8000, max_features: int = 4096, folds: int = 3, least_z: float = 3.0) -> Chain:
    """Learns the categories (name to SQL expression over the columns of `labels`, in the order of the chain).

    The classifier is fitted on at most max_docs labelled documents, those with the smallest hash of doc_id; copies of a text
    count once. Features are at most max_features hashed words: those whose share differs most between the classes, by
    least_z standard errors at least. They are counted and chosen on the executors; the driver gets only their places in
    each document. Without labelled documents every probability is 0.
    """
    names = list(categories)
    flags = [F.max(F.expr(e).cast("int")).alias(c) for c, e in categories.items()]
    chosen = smallest_hashes(labels.where("doc_id is not null").groupBy("doc_id").agg(*flags).dropna(), "doc_id", max_docs)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = ", ".join(["doc_id long", *(f"`{c}` int" for c in names), "words binary"])
    first = F.min(F.struct("doc_id", *(F.col(f"`{c}`") for c in names))).alias("first")
    sampled = saved(sample.mapInPandas(_featurise, schema).groupBy("words").agg(first).select("first.*", "words"))
    features = np.array(_telling(sampled, names, max_features // len(names), least_z), np.int64)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["places"] = [np.flatnonzero(np.isin(features, np.frombuffer(w, "<u4"), assume_unique=True)).astype(np.int32) for w in b["words"]]
            yield b.drop(columns=["words"])

    rows = sampled.mapInPandas(placed, schema.replace("words binary", "places array<int>")).toPandas().sort_values("doc_id", ignore_index=True, kind="stable")
    if rows.empty:
        return Chain({}, [Linear(c, -35.0, np.zeros(0), np.zeros(i), 0.5) for i, c in enumerate(names)])
    x = Rows.of_lists([np.asarray(p, np.int64) for p in rows["places"]], len(features))
    fold = np.array([zlib.crc32(str(d).encode()) % folds for d in rows["doc_id"]])
    dense, links = np.zeros((len(rows), 0)), []
    for c in names:
        y, p = rows[c].to_numpy(np.float64), np.zeros(len(rows))
        for k in range(folds):
            b, w, d = fit_linear(x, dense, y, fold != k)
            out = fold == k
            p[out] = _sigmoid(x.dot(w) + dense @ d + b)[out]
        b, w, d = fit_linear(x, dense, y, np.ones(len(rows), bool))
        links.append(Linear(c, b, w, d, _best_threshold(y, p)))
        dense = np.column_stack([dense, logit(p)])
    return Chain({int(h): i for i, h in enumerate(features)}, links)


def _probabilities(chain: Chain, rows: list[np.ndarray]) -> list[np.ndarray]:
    x, dense, out = Rows.of_lists(rows, len(chain.features)), np.zeros((len(rows), 0)), []
    for link in chain.links:
        p = _sigmoid(x.dot(link.weights) + dense @ link.earlier + link.bias)
        out.append(p)
        dense = np.column_stack([dense, logit(p)])
    return out


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) of every row, over its whole text.

    Null and empty texts have no words: they get the probability of the bias and are never in a category.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [link.category for link in chain.links]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, known = shared.value, {}
        for b in batches:
            if len(known) > _REMEMBERED:
                known = {}
            rows, empty = [], []
            for text in b["text"]:
                found = []
                words = tokens(text)
                for w in words:
                    k = known.get(w)
                    if k is None:
                        k = known[w] = tuple(chain.features[h] for h in hashes(w) if h in chain.features)
                    if k:
                        found += k
                rows.append(np.array(sorted(set(found)), np.int64))
                empty.append(not words)
            out = {"doc_id": b["doc_id"].astype("Int64")}
            probabilities = _probabilities(chain, rows)
            out |= {f"p_{c}": p for c, p in zip(names, probabilities, strict=True)}
            out |= {f"is_{link.category}": (p >= link.threshold) & ~np.array(empty, bool) for link, p in zip(chain.links, probabilities, strict=True)}
            yield pd.DataFrame(out)

    schema = ["doc_id long", *(f"`p_{c}` double" for c in names), *(f"`is_{c}` boolean" for c in names)]
    return docs.select("doc_id", "text").mapInPandas(run, ", ".join(schema))


#: The label table has two flags; what is low in quality is predicted first and helps to tell abuse from noise.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def keep_clean(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, reject: str = "toxic", max_docs: int = 8000) -> DataFrame:
    """Rows of `docs`, with its columns, that are not in the category `reject`; rows with a null doc_id stay.

    A doc_id goes if any text under it is rejected.
    """
    bad = score(docs, fit(docs, labels, categories, max_docs)).where(F.col(f"is_{reject}")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
