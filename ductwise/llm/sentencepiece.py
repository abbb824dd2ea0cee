"""SentencePiece encoding and decoding through a relational lattice of words and pieces.

The most frequent words of the corpus (a word is a run of spaces and what follows up to the next) are exploded into their
substrings up to the longest piece, and those are joined to the piece table. The edges of a word come together by word, and a
Spark higher-order aggregate folds them to its pieces. The scores of a byte-pair model are merge ranks, and the best sum of
them, a Viterbi fold, is not the model's own cut of seven in ten different words. So the fold here runs over the edges by
rank and keeps a bit for every cut: an edge takes out the only cut inside it, and after each the best edge is looked for anew.

A corpus has new words without end, and bringing the ids of each rare one back to its texts would move more bytes than the texts
have. Words beyond the most frequent ones, and those too long for a mask of cuts, are therefore merged where they stand,
by the same ranks. Such a word falls apart between letters and signs that are neighbours in no piece, as nothing is merged over
that place; its parts are remembered, as they come back more often than it does. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from math import inf
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import scratch, stored

SPACE = "▁"
#: Characters of a word whose cuts have a bit each in a long.
LONG = 62
#: Characters of a part up to which its best merge is looked for without a heap.
SCAN = 64
_FIND = re.compile(" *[^ ]+| +").findall
#: Different words that are counted, or parts that are remembered with their ids, at once; texts that are put out at once.
_WORDS, _TEXTS = 300_000, 1000


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: text to (id, score), ids of the bytes, and all pieces by id for decoding."""

    table: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    by_id: tuple[bytes, ...]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        table = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if i not in special and not sp.is_byte(i)}
        bytes_ = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        raw = {i: bytes([b]) for b, i in enumerate(bytes_)}
        return cls(table, bytes_, tuple(raw.get(i) or (b"" if i in special else sp.id_to_piece(i).replace(SPACE, " ").encode()) for i in ids))

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "replace")]

    @cached_property
    def ranks(self) -> dict[str, float]:
        """The pieces of two characters and more, with plain spaces; the least rank is merged first."""
        return {p.replace(SPACE, " "): -score for p, (_, score) in self.table.items() if len(p) > 1}

    @cached_property
    def packed(self) -> dict[str, bytes]:
        """The bytes of the id of each piece, with plain spaces."""
        return {p.replace(SPACE, " "): _bytes([i]) for p, (i, _) in self.table.items()}

    @cached_property
    def parts(self) -> Callable[[str], list[str]]:
        """Cuts a word where no piece lies across: between the largest group of characters that pieces join with one another, and all others."""
        joined, groups = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}, {}
        for a, b in joined:
            if a != " " and b != " " and (x := groups.setdefault(a, {a})) is not (y := groups.setdefault(b, {b})):
                x |= y
                groups.update(dict.fromkeys(y, x))
        group = "".join(map(re.escape, max(groups.values(), key=len, default="")))
        if not group or any(a != " " and b == " " for a, b in joined):  # spaces inside pieces
            return lambda unit: [unit]
        return re.compile(f" *[{group}]+| *[^{group} ]+| +").findall

    def merge(self, word: str) -> list[int]:
        """Ids of one word by its merges, best score first and of equal ones the left."""
        return np.frombuffer(b"".join(map(self.merged, self.parts(word.replace(SPACE, " ")))), "<u4").tolist()

    def merged(self, part: str) -> bytes:
        """The ids of a part by its merges."""
        found = self._scan(part) if len(part) <= SCAN else self._heap(part)
        out = list(map(self.packed.get, found))
        if None in out:
            out = [_bytes(self.fallback(c.replace(" ", SPACE))) if x is None else x for c, x in zip(found, out, strict=True)]
        return b"".join(out)

    def _scan(self, part: str) -> list[str]:
        """Looks for the best pair among all neighbours each time, which for a short part takes less than a heap."""
        rank, found = self.ranks.get, list(part)
        costs = list(map(rank, map(add, found, found[1:]), repeat(inf)))
        while costs and (best := min(costs)) < inf:
            i = costs.index(best)
            del costs[i]
            found[i] = here = found[i] + found.pop(i + 1)
            if i < len(costs):
                costs[i] = rank(here + found[i + 1], inf)
            if i:
                costs[i - 1] = rank(found[i - 1] + here, inf)
        return found

    def _heap(self, part: str) -> list[str]:
        n = len(part)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.ranks.get(part[i : end[j]])) is not None:
                heapq.heappush(heap, (found, i, end[j]))

        for i in range(n):
            offer(i)
        gone = [False] * (n + 1)
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or after[i] >= n or end[after[i]] != to:
                continue
            j = after[i]
            gone[j], end[i], after[i] = True, to, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(part[i : end[i]])
            i = after[i]
        return out


def units(text: str | None) -> list[str]:
    """Words of a text with the spaces before them; the model puts a space first and takes its mark for one."""
    return _FIND(f" {text}".replace(SPACE, " ")) if text else []


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Parts(dict):
    """The ids of parts of rare words, worked out when they first come."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes]):
        self.pieces, self.known = pieces, known

    def __missing__(self, part: str) -> bytes:
        if len(self) > _WORDS:
            self.clear()
        found = self.known.get(part)
        self[part] = found = self.pieces.merged(part) if found is None else found
        return found


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): for each word the pieces of two characters and more in it, best rank first.

    An edge is one long: the rank of its piece above 12 bits, then its start and its length with 6 bits each. The words are
    dealt out by unit once, and explode, join and grouping keep them where they are.
    """
    n = F.length("unit")
    starts = words.select("unit", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("start"))
    cut = starts.select("unit", "start", F.explode(F.sequence(F.lit(2), F.greatest(F.least(F.lit(longest), n - F.col("start")), F.lit(2)))).alias("len"))
    edges = cut.select("unit", "start", "len", F.substring("unit", F.col("start") + 1, F.col("len")).alias("piece")).join(F.broadcast(pieces), "piece")
    edge = F.col("rank") * 4096 + F.col("start") * 64 + F.col("len")
    return edges.where(F.length("piece") == F.col("len")).groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def fold(unit: Column, edges: Column) -> Column:
    """The cuts of a word as the bits of a long, from its edges by rank; bit 0 is its beginning.

    Each round takes the best edge that begins and ends at a cut and has one cut inside, and takes that one out.
    """
    one = F.lit(1).cast("long")
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    whole = shift(one, F.length(unit) + 1) - 1

    def masks(e: Column) -> Column:
        start, length = F.shiftright(e, 6).bitwiseAND(F.lit(63)).cast("int"), e.bitwiseAND(F.lit(63)).cast("int")
        begin = shift(one, start)
        end = shift(begin, length)
        return F.struct((end - begin * 2).alias("inside"), (begin + end).alias("ends"))

    def step(cuts: Column, e: Column) -> Column:
        inside = cuts.bitwiseAND(e["inside"])
        ready = (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(inside) == 1)
        return F.when(ready, inside).otherwise(F.lit(0).cast("long"))

    def best(cuts: Column, edges: Column) -> Column:
        """The cut that the best edge takes out, 0 if none does."""
        return F.aggregate(edges, F.lit(0).cast("long"), lambda found, e: F.when(found != 0, found).otherwise(step(cuts, e)))

    rounds = lambda edges: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(unit) - 1, F.lit(1))), whole, lambda cuts, _: cuts - best(cuts, edges))
    return F.element_at(F.transform(F.array(F.transform(edges, masks)), rounds), 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    frame = lambda: pd.DataFrame(list(counts.items()), columns=["unit", "n"])
    for b in batches:
        for t in b["text"]:
            counts.update(units(t))
            if len(counts) > _WORDS:
                yield frame()
                counts.clear()
    yield frame()


def different_words(docs: DataFrame) -> DataFrame:
    """(unit, n) of every different word, with plain spaces, and how often it occurs."""
    return docs.where("text <> ''").select("text").mapInPandas(_count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words at or over the lowest count that at most `most` of them reach; the count is found by a few passes of counters."""
    low, high = 1, (words.agg(F.sum("n")).first()[0] or 0) // max(most, 1) + 2  # no more than `most` words reach the upper end
    while low < high:
        marks = sorted({low + (high - low) * i // 32 for i in range(32)})
        over = words.agg(*[F.count_if(F.col("n") >= m).alias(str(m)) for m in marks]).first()
        first = next((i for i, m in enumerate(marks) if over[str(m)] <= most), len(marks))
        high = marks[first] if first < len(marks) else high
        low = marks[first - 1] + 1 if first else high
    return words.where(F.col("n") >= high)


def encoded_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, cuts) of the words of up to LONG characters, through the lattice; words without an edge are left out."""
    ranked = sorted((p for p in pieces.table if len(p) > 1), key=lambda p: (-pieces.table[p][1], pieces.table[p][0]))
    table = words.sparkSession.createDataFrame([(p.replace(SPACE, " "), i) for i, p in enumerate(ranked)], "piece string, rank long")  # as large as the model
    short = words.where(F.length("unit") <= LONG).select("unit")
    return lattice(short, table, max(map(len, ranked), default=2)).select("unit", fold(F.col("unit"), F.col("edges")).alias("cuts"))


def _ids(unit: str, cuts: int, pieces: Pieces) -> bytes:
    unit, out = unit.replace(" ", SPACE), []
    at = [i for i in range(len(unit) + 1) if cuts >> i & 1]
    for a, b in zip(at, at[1:]):
        found = pieces.table.get(unit[a:b])
        out += [found[0]] if found else pieces.fallback(unit[a:b])
    return _bytes(out)


def encode(docs: DataFrame, pieces: Pieces, most: int = 1 << 18, then: Callable[[pd.DataFrame, Pieces], pd.DataFrame] | None = None, schema: str = "doc_id long, text string, ids binary") -> DataFrame:
    """(doc_id, text, ids binary) of every row: little-endian unsigned 32-bit ids of the whole text.

    At most `most` words, the most frequent, pass through the lattice and go to every executor with their ids, which bounds
    what is broadcast; all others are merged in their texts. Null and empty texts have no ids. Equal rows are encoded each;
    other columns are not read; an empty table gives no rows. `then` makes rows of another `schema` of each frame before it leaves
    its worker, so that no second worker has to hold the texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with scratch(spark) as path:
        words = stored(different_words(docs), path)
        cuts = encoded_words(frequent(words, most).repartition("unit"), pieces).toPandas()
    shared = spark.sparkContext.broadcast((pieces, {u: _ids(u, int(c), pieces) for u, c in zip(cuts["unit"], cuts["cuts"], strict=True)}))

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, known = shared.value
        rare = _Parts(pieces, known).__getitem__

        def ids(text: str | None) -> bytes:
            found = list(map(known.get, own := units(text)))
            if None in found:
                found = [b"".join(map(rare, pieces.parts(u))) if x is None else x for u, x in zip(own, found, strict=True)]
            return b"".join(found)

        for whole in batches:
            for at in range(0, len(whole), _TEXTS):
                b = whole.iloc[at : at + _TEXTS]
                rows = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": b["text"], "ids": list(map(ids, b["text"]))})
                yield then(rows, pieces) if then else rows

    return docs.mapInPandas(assemble, schema)


def decode(ids: bytes, pieces: Pieces) -> str:
    """The text of ids; the space that encoding puts first is taken off."""
    raw = b"".join([pieces.by_id[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return raw.decode("utf-8", "replace").removeprefix(" ")


def round_trip(docs: DataFrame, model_path: str, most: int = 1 << 18) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, returns) of every row; `returns` says that decoding gives the text (null: empty) back.

    It does for every text without the mark U+2581 itself, which the model reads as a space.
    """

    def digest(b: pd.DataFrame, pieces: Pieces) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": b["doc_id"], "n_ids": [len(x) // 4 for x in b["ids"]], "ids_crc32": [zlib.crc32(x) for x in b["ids"]], "returns": [decode(x, pieces) == (t or "") for x, t in zip(b["ids"], b["text"], strict=True)]})

    return encode(docs, Pieces.load(model_path), most, digest, "doc_id long, n_ids long, ids_crc32 long, returns boolean")
