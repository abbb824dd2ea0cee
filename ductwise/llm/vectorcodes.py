"""Product codes of vectors: a codebook for each part, found through kd-trees, moved by distributed integer sums.

Everything is integer arithmetic, so the result does not depend on how rows are dealt out. In each round the codebooks, with a
kd-tree each, go to every executor (parts * entries rows of one part's width, whatever the number of vectors); each task looks up
its vectors in batches and sends one sum for each entry and component. The search visits a box of the tree whose bound equals the best
distance found so far, because an entry in it may be as near and have a lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import joined_by, saved, scratch, stored

#: Entries in a leaf of the tree.
LEAF = 4
#: Largest magnitude of a component before scaling: squares of differences then sum up within 64 bits.
LARGEST = 1 << 20


@dataclass
class Box:
    """Entries of a codebook, by index, and the box around them; two halves unless it is a leaf."""

    index: np.ndarray
    low: np.ndarray
    high: np.ndarray
    halves: list[Box] = field(default_factory=list)

    @classmethod
    def around(cls, entries: np.ndarray, index: np.ndarray | None = None) -> Box:
        index = np.arange(len(entries)) if index is None else index
        own = entries[index]
        box = cls(index, own.min(axis=0), own.max(axis=0))
        if len(index) > LEAF and (box.high > box.low).any():
            order = index[np.argsort(own[:, int(np.argmax(box.high - box.low))], kind="stable")]
            box.halves = [cls.around(entries, np.sort(half)) for half in (order[: len(order) // 2], order[len(order) // 2 :])]
        return box

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of this box may have from each row of x."""
        return (np.maximum(np.maximum(self.low - x, x - self.high), 0) ** 2).sum(axis=1)


def nearest(entries: np.ndarray, tree: Box, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, by branch and bound over the tree."""
    best, found = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))

    def visit(box: Box, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound <= best[rows]]  # an equal bound may hold a lower index
        if not len(rows):
            return
        if box.halves:
            one, two = (half.bound(x[rows]) for half in box.halves)
            first = one <= two
            for mask, order in ((first, (0, 1)), (~first, (1, 0))):
                for k in order:
                    visit(box.halves[k], rows[mask], (one, two)[k][mask])
            return
        far = ((x[rows][:, None, :] - entries[box.index][None, :, :]) ** 2).sum(axis=2)
        k = far.argmin(axis=1)  # the first of equals; a leaf's entries are in order
        far, k = far[np.arange(len(rows)), k], box.index[k]
        better = (far < best[rows]) | ((far == best[rows]) & (k < found[rows]))
        best[rows[better]], found[rows[better]] = far[better], k[better]

    if len(x):
        visit(tree, np.arange(len(x)), tree.bound(x))
    return found, best


def scaled(vector: str, scale: int):
    """The vector as whole numbers floor(scale * component); null where it is null or holds a component that is null or not finite."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(usable, F.transform(v, lambda x: F.floor(x * scale)))


@dataclass
class Codebooks:
    """entries[part]: (entry, position) as whole numbers."""

    entries: list[np.ndarray]
    trees: list[Box]

    @classmethod
    def of(cls, entries: list[np.ndarray]) -> Codebooks:
        return cls(entries, [Box.around(e) for e in entries])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) arrays of entry indexes and of squared distances."""
        split = np.split(x, len(self.entries), axis=1)
        both = [nearest(e, t, np.ascontiguousarray(p)) for e, t, p in zip(self.entries, self.trees, split, strict=True)]
        return np.stack([k for k, _ in both], axis=1), np.stack([d for _, d in both], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def _matrix(b: pd.DataFrame) -> np.ndarray:
    return np.stack(b["v"].to_numpy()).astype(np.int64)


def _moved(books: Codebooks, vectors: DataFrame) -> Codebooks:
    """Each entry at the floor of the mean of the parts that chose it; unused entries stay."""
    sc = vectors.sparkSession.sparkContext
    sent = sc.broadcast(books)
    parts, (entries, width) = len(books.entries), books.entries[0].shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, used = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            x = _matrix(b)
            slot = (sent.value.assign(x)[0] + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, slot, x.reshape(-1, width))
            used += np.bincount(slot, minlength=len(used))
        at = np.flatnonzero(used)
        yield pd.DataFrame({"slot": at.repeat(width), "k": np.tile(np.arange(width), len(at)), "total": total[at].reshape(-1), "used": used[at].repeat(width)})

    rows = vectors.select("v").mapInPandas(sums, "slot long, k long, total long, used long").groupBy("slot", "k").agg(F.sum("total").alias("total"), F.sum("used").alias("used"))
    flat = np.concatenate(books.entries).copy()
    for r in rows.collect():  # parts * entries * width rows at most
        flat[r["slot"], r["k"]] = r["total"] // r["used"]
    sent.unpersist()
    return Codebooks.of(np.split(flat, parts))


def compress(vectors: DataFrame, key: str, vector: str, label: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    Components become floor(scale * x); vectors are cut into `parts` equal parts. Codebooks begin with the parts of the rows with the
    `entries` smallest keys (of equal keys the smaller vector first, a null key last; fewer rows give fewer entries) and move `rounds` times.
    code has two hex digits for each part, so at most 256 entries; error is the squared distance summed over parts; label_error is its sum over
    rows of an equal label, null being one. Rows whose vector is null or holds null or non-finite components take no part.
    Repeated rows are rows like any other. Vectors of another length than the first row's, a length that parts do not divide, and
    components beyond LARGEST are an error. No usable rows give no rows. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    with scratch(vectors.sparkSession) as path:
        rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), scaled(vector, scale).alias("v")).where("v is not null")
        rows = stored(rows, f"{path}/rows")
        first = rows.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
        width = len(first[0]["v"]) if first else parts
        bad = rows.where((F.size("v") != width) | F.exists("v", lambda x: F.abs(x) > LARGEST * scale)).limit(1).count()
        if bad or width % parts or not width:
            raise ValueError(f"vectors must have one length, a multiple of {parts}, and components up to {LARGEST}")
        start = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
        books = Codebooks.of(np.split(start, parts, axis=1)) if first else None
        for _ in range(rounds if first else 0):
            books = _moved(books, rows)
        digest, sent = books.digest() if first else "", vectors.sparkSession.sparkContext.broadcast(books)
        kind = rows.schema["key"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

        def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                code, far = sent.value.assign(_matrix(b))
                yield pd.DataFrame({"key": b["key"], "label": b["label"], "code": [bytes(c).hex() for c in code.astype(np.uint8)], "error": far.sum(axis=1)})

        named = [F.col("key").cast("string").alias("key"), F.col("label").cast("string").alias("label")]
        coded = rows.select(*named, "v").mapInPandas(codes, "key string, label string, code string, error long")
        coded = stored(coded.withColumn("tag", F.struct(F.col("label").isNull(), F.coalesce("label", F.lit("")))), f"{path}/codes")
        sums = saved(coded.groupBy("tag").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
        out = joined_by(coded, sums, "tag", "n")
        return saved(out.select(F.col("key").cast(kind[0]).alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
