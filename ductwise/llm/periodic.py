"""Periodic runs of words: block matching finds a distance, exact extension both ways finds the run.

A run of smallest period q and length n is a stretch of n - q places whose word equals the one q places on. With at least four
periods that stretch is at least 3q long, so it holds a whole block of b words, aligned to a multiple of b, for the largest power of two b
with 2b - 1 <= 3q. For each such scale the aligned blocks of a document are keys of an Aho-Corasick automaton over word numbers, and
an occurrence of a block at a distance whose scale is b is a seed: from there the equality is extended both ways, word for
word. A stretch that has a smaller period as well is the same run at every one of its periods; the smallest stands for it.

Only places that can lie in a run of a scale are searched: there each word, from the second period on, was seen at most q places
before, for three periods in a row; and two runs of periods p and q have less than p + q places in common, so the inside of a run that is
known already holds no other of a longer period. Where no place is left, nothing is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ductwise.llm.common import to_bytes

#: A run has at least this many words and this many periods.
LEAST, PERIODS = 6, 4
NEW = ("runs_", "strongest_", "collapsed_")
ONE = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def numbered(words: list[bytes]) -> np.ndarray:
    """Each different word a number, in order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def since_last(ids: np.ndarray) -> np.ndarray:
    """How many places before each place its word stood last; the number of words where it is new."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), len(ids), np.int64)
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block, smallest period, largest period) of each scale that a text of n words has room for."""
    block = 1
    while True:
        low, high = max(1, -(-(2 * block - 1) // 3)), (4 * block - 2) // 3
        if max(LEAST, PERIODS * low) > n:
            return
        if low <= high:
            yield block, low, high
        block *= 2


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of each row of at least `least` true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    long = edge[1::2] - edge[::2] >= least
    return list(zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True))


def _reach(ids: np.ndarray, at: int, q: int) -> int:
    """How many places from `at` on hold the word that stands q places on."""
    n, step, done = len(ids) - q, 64, 0
    while at + done < n:
        a = at + done
        b = min(n, a + step)
        differ = np.flatnonzero(ids[a:b] != ids[a + q : b + q])
        if len(differ):
            return done + int(differ[0])
        done, step = done + b - a, 2 * step
    return done


def _back(ids: np.ndarray, at: int, q: int) -> int:
    """How many places before `at` hold the word that stands q places on."""
    step, done = 64, 0
    while done < at:
        b = at - done
        a = max(0, b - step)
        differ = np.flatnonzero(ids[a:b] != ids[a + q : b + q])
        if len(differ):
            return done + b - a - 1 - int(differ[-1])
        done, step = done + b - a, 2 * step
    return done


def _seeds(ids: np.ndarray, block: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of each aligned block that occurs again `low` to `high` places on."""
    word = tuple(ids.tolist())
    keys = dict.fromkeys(word[i : i + block] for i in range(0, len(word) - block + 1, block))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, key in enumerate(keys):
        automaton.add_word(key, k)
    automaton.make_automaton()
    met: dict[int, list[int]] = {}
    for end, k in automaton.iter(word):
        at = end - block + 1
        before = met.setdefault(k, [])
        while before and at - before[0] > high:
            before.pop(0)
        for i in before:
            if at - i >= low:
                yield i, at - i
        if at % block == 0:
            before.append(at)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, last, found = len(ids), since_last(ids), {}
    ends = periods = None  # of the longest run so far that holds a place
    for block, low, high in scales(n):
        mask = last <= high
        for (s, m), p in found.items():
            mask[s + p + high : max(s + p + high, s + m - p - high)] = False
        for a, b in stretches(mask, max(LEAST - high, (PERIODS - 1) * low)):
            a, covered = max(0, a - high), {}
            if ends is None:
                ends, periods = np.zeros(n, np.int64), np.ones(n, np.int64)
            for i, q in _seeds(ids[a:b], block, low, high):
                i += a
                if i < covered.get(q, 0) or (i + q + block <= ends[i] and q % periods[i] == 0):
                    continue  # this stretch is known, or is a run of a smaller period
                begin, end = i - _back(ids, i, q), i + _reach(ids, i, q)
                covered[q], length = end, end - begin + q
                if length >= max(LEAST, PERIODS * q) and q < found.get((begin, length), n):
                    found[begin, length] = q
                    longer = np.flatnonzero(ends[begin : begin + length] < begin + length) + begin
                    ends[longer], periods[longer] = begin + length, q
    return sorted((s, m, p) for (s, m), p in found.items())


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equals the one that starts first, then the one of the smaller period."""
    order = cmp_to_key(lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2])
    return min(found, key=order) if found else None


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, m, p in found:
        gone[s + p] += 1
        gone[s + m] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g] if found else words


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with runs_ (array of start, length, period by start, then period), strongest_ (the one of them with the most periods; null without runs) and collapsed_ (the words that stay, joined by one space).

    Words are what stands between white space (space, U+0009 to U+000D), whole texts. All rows and columns stay; a null or empty text
    has no runs and an empty collapsed_. Each row by itself: ties, repeated rows and null ids change nothing. No rows give no rows.
    Of the columns of `docs` those in `keep` stay (None: all); one that has the name of a new column gets out of its way.
    """
    kept_columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    docs = docs.select(*kept_columns, F.col(text).alias("text_"))
    schema = StructType([*docs.schema.fields[:-1], StructField(NEW[0], ArrayType(ONE)), StructField(NEW[1], ONE), StructField(NEW[2], StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([(c, pa.int64()) for c in ONE.names])
        as_dict = lambda r: dict(zip(ONE.names, r, strict=True))
        for b in batches:
            all_, best, kept = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = to_bytes(t).split()
                found = runs(numbered(words)) if len(words) >= LEAST else []
                all_.append([as_dict(r) for r in found])
                best.append(as_dict(strongest(found)) if found else None)
                kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "replace"))
            new = [pa.array(all_, pa.list_(one)), pa.array(best, one), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *NEW])

    return docs.mapInArrow(run, schema)
