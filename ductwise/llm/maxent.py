"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(token | context) = P(class | context) * P(member | class, context) * P(token | member). The first two factors are softmaxes
over few columns; their features are the word before, the word before that (a skip) and the pair of both, hashed into one
weight table, for the second factor together with the class. Both start from the shares of the training part, so the weights
only learn what the context adds. A member is one of the most frequent tokens by itself, in which case the third factor is 1,
or a group of less frequent words, where it is the word's smoothed share. The weights are trained by rounds of distributed
gradient updates: in each round every task runs through its share of a slice of the training documents in small steps from
the same weights, and the changes of a table row are averaged by how often each task used it. One epoch sees every training
document.

Counts cover every token of every training document. The most frequent words have ids on every executor (a fixed bound);
all other words meet their counts in a join on the 64-bit hash of the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import saved, scratch, stored, to_bytes

#: Classes, and members of a class.
CLASSES = 16
LEAVES = CLASSES * CLASSES
#: Leaf 0 is the end; then the most frequent words by themselves, groups by first and last letter, and the words without an id.
SINGLE = 200
RARE = LEAVES - 1
#: Rows of the weight table for each of the two factors; 16 bits hold a row.
FEATURES = 1 << 15
_BLOCK = 128
_STEP = 1 << 16
#: Most tasks that train at once, each from the same weights; a task sends its changes, of the size of the table at most.
_TASKS = 4096
_HASH = 42


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text; the end is the empty word."""
    return [*to_bytes(text).lower().split(), b""]


@dataclass
class Vocabulary:
    """ids of the most frequent tokens, their classes and counts; what all training tokens come to."""

    ids: Ids
    counts: np.ndarray
    leaves: np.ndarray
    total: int
    distinct: int

    @classmethod
    def of(cls, top: list[tuple[bytes, int]], total: int, distinct: int) -> Vocabulary:
        top = [(b"", dict(top).get(b"", 0)), *((w, c) for w, c in top if w)]
        leaves = np.array([0] + [1 + i if i < SINGLE else 1 + SINGLE + (w[0] * 7 + w[-1]) % (RARE - 1 - SINGLE) for i, (w, _) in enumerate(top[1:])], np.int64)
        return cls(Ids((w, i) for i, (w, _) in enumerate(top)), np.array([c for _, c in top], np.int64), leaves, total, distinct)

    @property
    def rare(self) -> int:
        """The id of every word that has none."""
        return len(self.counts)

    def base_divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def rare_divisor(self) -> float:
        known = int((self.counts > 0).sum())
        return self.total - int(self.counts.sum()) + 0.5 * (self.distinct - known + 1)

    def in_leaf(self) -> np.ndarray:
        """log10 of each token's share of its leaf; 0 for the rare id, whose words have theirs added later."""
        mass = np.bincount(self.leaves, self.counts + 0.5, LEAVES)
        return np.append(np.log10((self.counts + 0.5) / mass[self.leaves]), 0.0)

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the smoothed mass of each class, and of each member of a class: where both factors start."""
        mass = np.bincount(self.leaves, self.counts, LEAVES) + 0.5
        mass[RARE] += self.total - int(self.counts.sum())
        mass = mass.reshape(CLASSES, CLASSES)
        by_class = mass.sum(1)
        return np.log(by_class / by_class.sum()).astype(np.float32), np.log(mass / by_class[:, None]).astype(np.float32)

    def of_token(self) -> tuple[np.ndarray, np.ndarray]:
        """(class, member of the class) of each id, the rare id included."""
        leaf = np.append(self.leaves, RARE)
        return leaf // CLASSES, leaf % CLASSES


class Ids(dict):
    """Ids of the tokens that have one; all others have the next free number."""

    def __missing__(self, token: bytes) -> int:
        return len(self)


def encode(texts: list[str | None], ids: Ids) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(ids of all texts, tokens of each text, words of each text that have no id)."""
    id_of, rare, out, n, odd = ids.__getitem__, len(ids), [], [], []
    for t in texts:
        words = tokens(t)
        x = np.array(list(map(id_of, words)), np.int64)
        n.append(len(x))
        odd.append([words[i] for i in np.flatnonzero(x == rare)])
        out.append(x)
    return np.concatenate([*out, np.zeros(0, np.int64)]), np.array(n, np.int64), odd


def features(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys of each token's context: the word before, the one before that, and both; 0s before the beginning."""
    one, two = np.append(np.zeros(1, np.int64), x[:-1] + 1), np.append(np.zeros(min(2, len(x)), np.int64), x[:-2] + 1)
    begin = np.cumsum(n) - n
    one[begin], two[begin] = 0, 0
    second = begin[n > 1] + 1
    two[second] = 0
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    return np.stack([a * np.uint64(3) + np.uint64(1), b * np.uint64(3) + np.uint64(2), (a * np.uint64(1 << 20) + b) * np.uint64(3)], 1)


def rows_of(keys: np.ndarray) -> np.ndarray:
    """Rows of a table of FEATURES rows."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def within(keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys of contexts together with a class."""
    return keys + ((classes.astype(np.uint64) + np.uint64(1)) << np.uint64(42))[:, None]


def _logits(weights: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    z = weights.take(rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], 0)
    z += start
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    """Sum of each row; a product is faster over few columns."""
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax_logs(weights: np.ndarray, rows: np.ndarray, start: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = _logits(weights, rows, start)
    own = z.ravel().take(np.arange(len(y)) * z.shape[1] + y)
    return own - np.log(_sums(np.exp(z, out=z)))


def token_logs(weights: np.ndarray, keys: np.ndarray, classes: np.ndarray, members: np.ndarray, priors: tuple[np.ndarray, np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """Natural logarithm of P(class | context) * P(member | class, context) for each token. Weights are kept small, so exp is safe."""
    out = np.empty(len(classes), np.float64)
    for at in range(0, len(classes), step):
        k, c, m = keys[at : at + step], classes[at : at + step], members[at : at + step]
        out[at : at + step] = _softmax_logs(weights[:FEATURES], rows_of(k), priors[0], c)
        out[at : at + step] += _softmax_logs(weights[FEATURES:], rows_of(within(k, c)), priors[1][c], m)
    return out


def _step(weights: np.ndarray, rows: np.ndarray, start: np.ndarray, label: np.ndarray, used: np.ndarray, square: np.ndarray, rate: float, most: float) -> None:
    n = len(label)
    g = _logits(weights, rows, start)
    np.exp(g, out=g)
    g /= _sums(g)[:, None]
    g[np.arange(n), label] -= 1
    # one column at a time, so that nothing of the size of tokens times columns is gathered; only rows in use change
    flat = rows.T.ravel()
    count = np.bincount(flat, minlength=len(weights))
    at = np.flatnonzero(count)
    count = count[at].astype(np.float32)
    total = np.empty((len(at), g.shape[1]), np.float32)
    for k in range(g.shape[1]):
        total[:, k] = np.bincount(flat, np.tile(g[:, k], rows.shape[1]), len(weights))[at]
    total /= np.sqrt(count)[:, None]
    used[at] += count
    square[at] += total * total
    weights[at] = np.clip(weights[at] - rate * total / np.sqrt(square[at] + 1e-2), -most, most)


def learn(weights: np.ndarray, keys: np.ndarray, classes: np.ndarray, members: np.ndarray, priors: tuple[np.ndarray, np.ndarray], used: np.ndarray, square: np.ndarray, rate: float = 0.25, most: float = 20.0) -> None:
    """Adagrad steps of both factors over the tokens in order, _STEP at a time; changes weights, used (tokens for each row) and square."""
    for at in range(0, len(classes), _STEP):
        k, c, m = keys[at : at + _STEP], classes[at : at + _STEP], members[at : at + _STEP]
        for part, rows, start, label in ((slice(0, FEATURES), rows_of(k), priors[0], c), (slice(FEATURES, None), rows_of(within(k, c)), priors[1][c], m)):
            _step(weights[part], rows, start, label, used[part], square[part], rate, most)


def _train(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, start = shared.value
        weights, used, square = start.copy(), np.zeros(len(start), np.float32), np.zeros_like(start)
        (classes, members), priors = vocabulary.of_token(), vocabulary.priors()
        for b in batches:
            for i in range(0, len(b), 200):
                x, n, _ = encode(b["text"].iloc[i : i + 200].tolist(), vocabulary.ids)
                learn(weights, features(x, n), classes[x], members[x], priors, used, square)
        change = (weights - start) * used[:, None]
        for k in np.flatnonzero(used.reshape(-1, _BLOCK).any(1)):
            part = slice(k * _BLOCK, (k + 1) * _BLOCK)
            yield pd.DataFrame({"block": [k], "used": [used[part].tobytes()], "change": [change[part].astype("<f4").tobytes()]})

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    used = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in group["used"])
    change = sum(np.frombuffer(x, "<f4").astype(np.float64).reshape(_BLOCK, CLASSES) for x in group["change"])
    mean = change / np.maximum(used, 1)[:, None]
    return pd.DataFrame({"block": [int(group["block"].iloc[0])], "change": [mean.astype("<f4").tobytes()]})


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 3) -> np.ndarray:
    """Weight table: FEATURES rows for the classes, then as many for their members, by CLASSES columns. One task trains for each partition of the input, _TASKS at most, whatever the cluster."""
    spark = docs.sparkSession
    weights = np.zeros((2 * FEATURES, CLASSES), np.float32)
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        tasks = min(max(1, part.rdd.getNumPartitions()), _TASKS)
        shared = spark.sparkContext.broadcast((vocabulary, weights))
        changed = part.coalesce(tasks).mapInPandas(_train(shared), "block int, used binary, change binary").groupBy("block").applyInPandas(_merge, "block int, change binary").collect()
        for row in changed:
            weights[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] += np.frombuffer(row["change"], "<f4").reshape(_BLOCK, CLASSES)
        shared.unpersist()
    return weights


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for b in batches:
        for t in b["text"]:
            counts.update(tokens(t))
        if len(counts) > 400_000:
            yield pd.DataFrame(list(counts.items()), columns=["word", "c"])
            counts = Counter()
    yield pd.DataFrame(list(counts.items()), columns=["word", "c"])


def frequent(counts: DataFrame, most: int, total: int) -> list[tuple[bytes, int]]:
    """Words at or over the lowest count that at most `most` words reach, and the end; by count, then bytes.

    The count is searched for in a few passes of counters, so that not every partition sends its own first words.
    """
    low, high = 1, total // max(most, 1) + 2  # no more than `most` words reach the upper end
    while low < high:
        marks = sorted({low + (high - low) * i // 32 for i in range(32)})
        over = counts.agg(*[F.count_if(F.col("c") >= m).alias(str(m)) for m in marks]).first()
        first = next((i for i, m in enumerate(marks) if over[str(m)] <= most), len(marks))
        high = marks[first] if first < len(marks) else high
        low = marks[first - 1] + 1 if first else high
    rows = counts.where((F.col("c") >= high) | (F.length("word") == 0)).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, weights = shared.value
        (classes, members), priors, share = vocabulary.of_token(), vocabulary.priors(), vocabulary.in_leaf()
        base = np.append(np.log10((vocabulary.counts + 0.5) / vocabulary.base_divisor()), 0.0)
        known = np.append((vocabulary.counts > 0).astype(np.int64), 0)
        row, digest = TaskContext.get().partitionId() << 40, xxhash.xxh64_intdigest
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                x, n, odd = encode(part["text"].tolist(), vocabulary.ids)
                logs = token_logs(weights, features(x, n), classes[x], members[x], priors)
                begin = np.cumsum(n) - n
                yield pd.DataFrame(
                    {
                        "row": row + np.arange(len(part)),
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "n_tokens": n,
                        "n_known": np.add.reduceat(known[x], begin),
                        "base": np.add.reduceat(base[x], begin),
                        "model": np.add.reduceat(logs / np.log(10) + share[x], begin),
                        "rare": [np.array([digest(w, _HASH) for w in words], np.uint64).view(np.int64) for words in odd],
                    }
                )
                row += len(part)

    return run


def score(docs: DataFrame, max_words: int = 1 << 17, rounds: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, over its whole text.

    Learns from the rows that are not held out. A null text is empty: only the end. Repeated rows count and are scored each,
    an empty table gives no rows, a training part without rows gives every token the same share. Other columns are not read.
    max_words bounds the words that have an id and so the model's size; counts of all other words are joined.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id")))
    with scratch(spark) as path:
        counts = stored(training.select("text").mapInPandas(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), f"{path}/counts")
        total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
        top = frequent(counts, max_words, total or 0)
        vocabulary = Vocabulary.of(top, total or 0, distinct)
        weights = train(training, vocabulary, rounds)
        shared = spark.sparkContext.broadcast((vocabulary, weights))
        rows = stored(docs.mapInPandas(_score(shared), "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<long>"), f"{path}/rows")
        with_id = spark.createDataFrame([(bytearray(w),) for w in vocabulary.ids], "word binary")
        others = counts.join(F.broadcast(with_id), "word", "left_anti").select(F.xxhash64("word").alias("h"), "c")
        found = rows.select("row", F.explode("rare").alias("h")).join(others, "h", "left")
        found = found.groupBy("row").agg(F.count("c").alias("more"), F.count("*").alias("n_rare"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
        out = rows.drop("rare").join(found, "row", "left").na.fill(0, ["more", "n_rare", "logs"])
        base = F.col("base") + F.col("logs") - F.col("n_rare") * float(np.log10(vocabulary.base_divisor()))
        model = F.col("model") + F.col("logs") - F.col("n_rare") * float(np.log10(vocabulary.rare_divisor()))
        return saved(out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(total or 0).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score")))
