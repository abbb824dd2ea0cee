"""Best-fit packing of token sequences: bin completion with branch and bound on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the whole packing problem is a histogram of at most `capacity` counts.
The search runs on that, whatever the corpus size: it takes the largest length left, enumerates undominated fillings around
it, prunes those that waste more than the incumbent allows, and starts from the best-fit-decreasing packing as incumbent.
The plan is a short list of (filling, how often); each piece finds its place in it from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import saved, tokenizer, unused

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: equal bins are handled together."""
    bins: dict[tuple[int, ...], int] = {}
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in range(size, capacity):
            # what is put into a bin here leaves it in rooms[room - size], which may be looked at again only in the next pass
            while left and rooms[room]:
                items, n = rooms[room].popitem()
                each = min(room // size, max(1, left // n))
                used = min(n, left // each)
                if used < n:
                    rooms[room][items] = n - used
                left -= used * each
                new = rooms[room - each * size]
                new[items + (size,) * each] = new.get(items + (size,) * each, 0) + used
            if not left:
                break
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            for k, n in ((each, full), (rest, 1)):
                if k and n:
                    new = rooms[capacity - k * size]
                    new[(size,) * k] = new.get((size,) * k, 0) + n
    for group in rooms:
        for items, n in group.items():
            bins[items] = bins.get(items, 0) + n
    return sorted(bins.items(), reverse=True)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest bins by volume, and by the large items with what cannot join them (for every threshold)."""
    n = np.zeros(capacity + 2, np.int64)
    for size, c in counts.items():
        n[size] = c
    volume, best = int((n[: capacity + 1] * np.arange(capacity + 1)).sum()), 0
    at = np.arange(capacity + 1)
    best = -(-volume // capacity)
    for k in range(capacity // 2 + 1):
        big = int(n[capacity - k + 1 : capacity + 1].sum())
        mid = slice(capacity // 2 + 1, capacity - k + 1)
        n_mid, free = int(n[mid].sum()), int(((capacity - at[mid]) * n[mid]).sum())
        small = int((at[k : capacity // 2 + 1] * n[k : capacity // 2 + 1]).sum())
        best = max(best, big + n_mid + max(0, -(-(small - free) // capacity)))
    return best


def _reachable(left: list[int]) -> list[int]:
    """For every size the sums, as bits, that items of at most that size can add up to."""
    capacity = len(left) - 1
    mask, sums, out = (1 << capacity + 1) - 1, 1, [1]
    for size in range(1, capacity + 1):
        n, step = min(left[size], capacity // size), 1
        while n > 0:  # n copies as 1, 2, 4 ... and the rest
            step = min(step, n)
            sums |= sums << size * step & mask
            n -= step
            step *= 2
        out.append(sums)
    return out


def fillings(room: int, top: int, left: list[int], spare: Callable[[], int], band: int, sums: list[int], tick: Callable[[], bool]) -> Iterator[tuple[int, ...]]:
    """Undominated multisets of lengths up to `top` that fill `room`, as far as spare() allows: by rising waste in bands, largest items first in a band.

    A filling is dominated if a length that is left fits beside it, or can take the place of one of its items together with
    the waste. `left` may change between two steps, if it is as before when the next is asked for. Each step asks tick(), and
    none are left when it says no.
    """
    free = lambda size, items: left[size] > items.count(size)

    def undominated(waste: int, items: list[int]) -> bool:
        return not any(free(x, items) for x in range(1, waste + 1)) and not any(free(x, items) for item in set(items) for x in range(item + 1, min(item + waste, top) + 1))

    for least in range(0, room + 1, band + 1):
        if least > spare():
            return
        items: list[int] = []
        need = room - least
        size = min(top, need)
        while True:
            low = max(0, need - band)
            wanted = (1 << need - low + 1) - 1
            while size and not (left[size] > 0 and sums[size] >> low & wanted):
                size -= 1
            if not tick():
                for x in items:
                    left[x] += 1
                return
            if size:
                items.append(size)
                left[size] -= 1
                need -= size
                size = min(size, need)
                continue
            if not low:
                for x in items:
                    left[x] += 1
                if least + need <= spare() and undominated(least + need, items):
                    yield tuple(items)
                for x in items:
                    left[x] -= 1
            if not items:
                break
            size = items.pop()
            left[size] += 1
            need += size
            size -= 1


@dataclass
class _Choice:
    """The largest length left at a point of the search, its fillings still to try, and the one in use `n` times."""

    top: int
    others: Iterator[tuple[int, ...]]
    whole: tuple[int, ...] = ()
    n: int = 0
    waste: int = 0


def plan(counts: dict[int, int], capacity: int, steps: int = 300_000) -> Plan:
    """Fillings and how often each is used; every item of the histogram is in exactly one.

    Starts from best fit decreasing. A branch takes a filling of the largest length left as often as it goes, and later
    fewer times; the search is over when the lower bound is met or every branch is pruned, and then the answer is the least.
    `steps` bounds the work of the search, not the items packed: when they are spent, the incumbent is the answer. One
    histogram is changed and restored in place, so memory grows with the depth alone.
    """
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit(counts, capacity)
    most, least = sum(n for _, n in best), lower_bound(counts, capacity)
    if most == least:
        return best
    left = [counts.get(s, 0) for s in range(capacity + 1)]
    volume, sums = sum(s * c for s, c in counts.items()), _reachable(left)
    used, waste, budget, nodes, every = 0, 0, steps, 0, max(1, len(counts) // 64)
    band = max(0, (most - 1) * capacity - volume) // most  # the waste that a bin may have on average
    stack: list[_Choice] = []

    def tick() -> bool:
        nonlocal budget
        budget -= 1
        return budget > 0

    def spare() -> int:
        """Waste that a solution better than the incumbent may still add."""
        return (most - 1) * capacity - volume - waste

    def put(c: _Choice, n: int) -> None:
        nonlocal used, waste
        for size in c.whole:
            left[size] -= n
        c.n += n
        used += n
        waste += n * c.waste

    def offer(rest: Plan) -> None:
        nonlocal best, most
        n = used + sum(k for _, k in rest)
        if n < most:
            best, most = [(c.whole, c.n) for c in stack if c.n] + rest, n

    def descend() -> None:
        top = stack[-1].top if stack else capacity
        while top and not left[top]:
            top -= 1
        if top:
            left[top] -= 1
            stack.append(_Choice(top, fillings(capacity - top, top, left, spare, band, sums, tick)))
            left[top] += 1
        else:
            offer([])

    descend()
    while stack and budget > 0 and most > least:
        c = stack[-1]
        if c.n > 1:  # all below one use less has been tried
            put(c, -1)
        else:
            put(c, -c.n)
            left[c.top] -= 1
            items = next(c.others, None)
            left[c.top] += 1
            if items is None:
                stack.pop()
                continue
            c.whole = (c.top, *items)
            c.waste = capacity - sum(c.whole)
            n = min(left[s] // k for s, k in Counter(c.whole).items())
            put(c, max(1, min(n, spare() // c.waste if c.waste else n)))
        if spare() < 0:
            continue
        nodes += 1
        if nodes % every == 0:  # best fit of what is left is a new incumbent if it does better
            rest = {s: k for s, k in enumerate(left) if k}
            budget -= len(rest)
            offer(best_fit(rest, capacity))
        descend()
    return best


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id, cut only where longer than capacity."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, step = tokenizer(tokenizer_path, "word"), 4 * capacity
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["text"], strict=True):
                raw = tok.ids(text) + end
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    out.append((doc, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = 2048, steps: int = 300_000, parts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (with doc_id, piece and length from 1 to capacity; other columns are kept).

    Pieces are put in order of length and dealt out in ranges, so that a length that very many share is spread over many
    tasks. The driver gets one count for each length in each range: no more than the lengths and the ranges together. No
    pieces give no rows; repeated pieces are packed as often as they come.
    """
    spark = rows.sparkSession  # the rows are kept before they are dealt out, which looks at them twice
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = rows.schema
    in_part, nth_name = unused(rows, "part", "nth")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            nth = b.groupby("length").cumcount()
            b[in_part], b[nth_name] = part, nth + b["length"].map(seen).fillna(0).astype("int64")
            for size, n in b["length"].value_counts().items():
                seen[size] = seen.get(size, 0) + int(n)
            yield b

    spread = saved(rows).repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    marked = saved(spread.mapInPandas(mark, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"{in_part} int", f"{nth_name} long"])))
    counted = marked.groupBy("length", in_part).count().orderBy("length", in_part).collect()
    counts: dict[int, int] = {}
    base: list[tuple[int, int, int]] = []
    for r in counted:
        base.append((r["length"], r[in_part], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    slots, done, seq = [], {}, 0
    for items, n in plan(counts, capacity, steps):
        at = 0
        for size in sorted(set(items), reverse=True):
            k = items.count(size)
            slots.append((size, done.get(size, 0), done.get(size, 0) + n * k, k, seq, at))
            done[size] = done.get(size, 0) + n * k
            at += k * size
        seq += n
    tables = (pd.DataFrame(slots, columns=["length", "low", "high", "each", "seq", "at"]), {(a, b): c for a, b, c in base})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {int(size): x.sort_values("low") for size, x in tables[0].groupby("length")}
        for b in batches:
            seq, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for (size, part), at in b.groupby(["length", in_part]).indices.items():
                s = by[int(size)]
                rank = b[nth_name].to_numpy()[at] + tables[1][int(size), int(part)]
                i = np.searchsorted(s["low"].to_numpy(), rank, "right") - 1
                within = rank - s["low"].to_numpy()[i]
                seq[at] = s["seq"].to_numpy()[i] + within // s["each"].to_numpy()[i]
                offset[at] = s["at"].to_numpy()[i] + within % s["each"].to_numpy()[i] * int(size)
            b = b.drop(columns=[in_part, nth_name])
            b["sequence_id"], b["offset"] = seq, offset
            yield b

    return marked.mapInPandas(place, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, steps: int = 300_000) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and take one end id. Repeated documents are packed each; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity, steps)
