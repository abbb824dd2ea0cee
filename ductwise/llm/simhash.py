"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify the Hamming distance.

A fingerprint has 64 bits cut into B blocks. Two fingerprints that differ in at most k bits agree on at least B-k whole
blocks, so they share the key of one of the C(B, k) choices of B-k blocks. B grows with the number of different
fingerprints, so that a key holds few unrelated ones at any size; the links found are the same for every B.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import BROADCAST, saved, to_bytes
from ductwise.llm.components import components

BITS = 64
#: Fingerprints of one key that are compared in one place; a larger key is dealt out as pairs of chunks of half as many.
GROUP = 4096
#: Shingles of one group of texts that are compared in one place.
SHINGLES = 1 << 22


def _shingles(text: str | None, width: int, seed: int = 42, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased word shingles of a whole text, repeats included; a text of fewer words is one shingle."""
    split = to_bytes(text).lower().split()
    if not split:
        return
    joined, lens = b" ".join(split), np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lens + 1) - 1
    starts, n = ends - lens, max(1, len(split) - width + 1)
    ends = ends[width - 1 :] if len(split) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        pairs = zip(starts[at : min(n, at + block)].tolist(), ends[at : at + block].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64)


def _majority(hashes: Iterable[np.ndarray], words: int) -> tuple[int, ...]:
    ones, n = np.zeros((words, BITS), np.int64), 0
    for h in hashes:
        n += len(h)
        for k in range(words):
            ones[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return tuple(sum(1 << int(i) for i in np.flatnonzero(2 * x > n)) for x in ones)


def fingerprint(text: str | None, width: int = 4, words: int = 1, seed: int = 42, block: int = 1 << 16) -> tuple[int, ...]:
    """SimHash of the lower-cased word shingles of a whole text, repeats counted; 0 without words.

    `words` numbers of 64 bits: the first from the shingles' hash itself, further ones from that hash mixed again.
    """
    return _majority(_shingles(text, width, seed, block), words)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The different shingle hashes of a whole text in order."""
    return np.unique(np.concatenate([*_shingles(text, width), np.zeros(0, np.uint64)])).astype("<u8")


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, f0 long, f1 long ...) of every row; null and empty texts have fingerprint 0."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(t, width, words) for t in b["text"]], np.uint64).reshape(len(b), words).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **{n: found[:, k] for k, n in enumerate(names)}})

    return docs.select("doc_id", "text").mapInPandas(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks of every choice of blocks - distance blocks."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    one = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    masks = (sum(one[i] for i in kept) for kept in combinations(range(blocks), blocks - distance))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def choose_blocks(n: int, distance: int) -> int:
    """The number of blocks with the least work for n fingerprints: keys to deal out, about 2 microseconds each, and pairs that share a key by chance, about 10 nanoseconds each. Two blocks at least agree, so that few fingerprints and many are dealt out alike."""

    def work(blocks: int) -> float:
        tables = math.comb(blocks, distance)
        return tables * n * (2e-6 + n / 2 ** (BITS * (blocks - distance) / blocks) / 2 * 1e-8)

    return min(range(distance + 2, distance + 6), key=work)


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by g, joined and cut again so that no group is in two."""
    held: list[pd.DataFrame] = []
    for b in batches:
        g = b["g"].to_numpy()
        if not len(g):
            continue
        cut = int(np.searchsorted(g, g[-1])) if (g[1:] >= g[:-1]).all() else int(np.flatnonzero(g != g[-1])[-1]) + 1
        if cut or (held and held[-1]["g"].iloc[-1] != g[-1]):
            yield pd.concat([*held, b.iloc[:cut]])
            held = [b.iloc[cut:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held)


def _verify(names: list[str], distance: int, within: int):
    """Edges among rows sorted by group: nodes within `within` bits over all words and `distance` in one, without those that earlier edges of the group already connect."""

    def edges(group: np.ndarray, fps: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(group)
        last = np.append(np.flatnonzero(group[1:] != group[:-1]), n - 1)
        end = last[np.searchsorted(last, np.arange(n))]
        label, at, found = np.arange(n), np.arange(n), []
        lag = 1
        while True:
            at = at[at + lag <= end[at]]
            if not len(at):
                break
            a, b = at, at + lag
            apart = [np.bitwise_count(f[a] ^ f[b]) for f in fps]
            near = (sum(x.astype(np.int32) for x in apart) <= within) & (np.minimum.reduce(apart) <= distance)
            near &= (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[near], b[near]
            if len(a):
                found.append((a, b))
                while True:
                    low = np.minimum(label[a], label[b])
                    new = label.copy()
                    np.minimum.at(new, label[a], low)
                    np.minimum.at(new, label[b], low)
                    new = new[new]
                    new = np.minimum(new, new[label])
                    if (new == label).all():
                        break
                    label = new
            lag += 1
        if not found:
            return at, at
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches):
            x, y = edges(b["g"].to_numpy(), [b[n].to_numpy().view(np.uint64) for n in names], b["side"].to_numpy())
            yield pd.DataFrame({f"{side}_{n}": b[n].to_numpy()[at] for side, at in (("a", x), ("b", y)) for n in names})

    return run


def node_of(*names: str) -> Column:
    """The node of a fingerprint."""
    return F.xxhash64(*names) if len(names) > 1 else F.col(names[0])


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None, within: int | None = None, closest: int | None = None) -> DataFrame:
    """Edges (a, b) between the nodes (see node_of) of different fingerprints (f0 long, f1 long ...; a column `node` is not read).

    Two nodes link if their fingerprints differ in at most `within` bits over all words (default: distance) and in at most
    `closest` bits in one of them (default: distance). With a larger `closest`, nodes more than `distance` apart in every
    word link if they share a key all the same, as most that are little further apart do. Not every such pair is listed, but every one is connected by listed edges: within a key,
    pairs that are connected already are left out. A key of more than GROUP fingerprints is compared as pairs of chunks, so no
    task holds it whole. There are at most rows / GROUP such keys; up to BROADCAST of them go to every executor, more are joined.
    """
    names = [c for c in fps.columns if c != "node"]
    blocks = blocks or choose_blocks(fps.count(), distance)
    keys = [F.xxhash64(F.col(n).bitwiseAND(F.lit(m)), F.lit(f"{n}-{i}")) for n in names for i, m in enumerate(block_masks(blocks, distance))]
    keyed = fps.select(*names, F.explode(F.array(*keys)).alias("key"))
    large = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    dealt = keyed.join(F.broadcast(large) if large.count() <= BROADCAST else large, "key", "left")
    dealt = dealt.withColumn("c", F.coalesce(F.ceil(F.col("n") / (GROUP // 2)), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(*names, F.lit(7)), F.col("c")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    #: side 2: compare within the chunk; otherwise only across the two chunks.
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = dealt.select(F.xxhash64("key", low, high).alias("g"), *names, side.cast("int").alias("side"))
    verify = _verify(names, distance if closest is None else closest, distance if within is None else within)
    found = rows.repartition("g").sortWithinPartitions("g").mapInPandas(verify, ", ".join(f"{side}_{n} long" for side in "ab" for n in names))
    return found.select(node_of(*[f"a_{n}" for n in names]).alias("a"), node_of(*[f"b_{n}" for n in names]).alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, blocks: int | None = None, words: int = 1, within: int | None = None) -> DataFrame:
    """(doc_id, f0 ..., component_id) of every document; component_id is the smallest doc_id reachable over links.

    Documents of one fingerprint count as one node, so a group of copies of any size costs one. Null and empty texts have
    fingerprint 0 and link like any other. Repeated doc_ids give a row each; no documents give no rows. Other columns of
    `docs` are not read. A null doc_id is a row of its own and never names a component that has another.
    """
    names = [f"f{k}" for k in range(words)]
    fps = saved(fingerprints(docs, width, words))
    nodes = saved(fps.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", node_of(*names)))
    roots = components(links(nodes.select(*names), distance, blocks, within)).select("node", "root")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "root").select(*names, "component_id"), names).select("doc_id", *names, "component_id")


def _alike(names: list[str], within: int, least: float):
    """Edges among rows sorted by group: nodes whose shingle sets have a Jaccard similarity of `least` or more, of those within `within` bits, without pairs that earlier edges of the group already connect."""

    def edges(b: pd.DataFrame) -> tuple[list[int], list[int]]:
        fps, side = [b[n].to_numpy().view(np.uint64) for n in names], b["side"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in b["shingles"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        start, mark = np.cumsum(size) - size, np.zeros(len(values), bool)
        label, x, y = np.arange(len(sets)), [], []
        for i in range(len(sets) - 1):
            j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            j = j[((side[j] != side[i]) | (side[j] == 2)) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-9)]
            j = j[sum(np.bitwise_count(f[j] ^ f[i]).astype(np.int32) for f in fps) <= within]
            if not len(j):
                continue
            mark[code[start[i] : start[i] + size[i]]] = True
            first = np.cumsum(size[j]) - size[j]
            both = np.add.reduceat(mark[code[np.repeat(start[j] - first, size[j]) + np.arange(size[j].sum())]], first, dtype=np.int64)
            mark[code[start[i] : start[i] + size[i]]] = False
            j = j[both >= least * (size[j] + size[i] - both) - 1e-9]
            if len(j):
                x += [i] * len(j)
                y += j.tolist()
                label[np.isin(label, label[j])] = label[i]
        return x, y

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches):
            for _, b in whole.groupby("g", sort=False):
                node, (x, y) = b["node"].to_numpy(), edges(b)
                yield pd.DataFrame({"a": node[x], "b": node[y]})

    return run


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, distance: int = 10, words: int = 2, within: int = 32) -> DataFrame:
    """(doc_id, component_id) of every document with a doc_id; links join texts whose sets of shingles have a Jaccard similarity of `least`.

    Fingerprints only search: those that share a key and are at most `within` bits apart make candidate groups, and in
    each group the sets of hashed shingles decide. At a similarity of 0.8, fingerprints of 128 bits, here of the set,
    differ in 19 bits on average and in more than 32 in one case of a thousand, while unrelated texts differ in 64. Texts of
    one set count as one node. A group of more than GROUP nodes, or of very long texts, is compared as pairs of chunks.
    """
    names = [f"f{k}" for k in range(words)]

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b["text"]]
            found = np.array([_majority([s[i : i + (1 << 16)] for i in range(0, len(s), 1 << 16)], words) for s in sets], np.uint64).reshape(len(b), words).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "tx": b["tx"], "node": node, "size": [len(s) for s in sets], **{n: found[:, k] for k, n in enumerate(names)}})

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(shingles=[shingle_set(t, width).tobytes() for t in b["text"]]).drop(columns="text")

    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("tx"))
    fps = saved(texts.mapInPandas(prints, ", ".join(["doc_id long, tx long, node long, size long", *(f"{n} long" for n in names)])))
    nodes = saved(fps.groupBy("node").agg(F.min(F.struct("doc_id", "tx")).alias("one"), F.first("size").alias("size"), *(F.first(n).alias(n) for n in names)))
    near = components(links(nodes.select(*names).distinct(), distance, None, within, BITS)).select(F.col("node").alias("fp"), "root")
    nodes = nodes.withColumn("fp", node_of(*names))
    near = nodes.join(near, "fp", "left").select("node", "size", F.coalesce("root", "fp").alias("root"))
    chunks = near.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where("n > 1")
    chunks = chunks.select("root", F.when((F.col("n") <= GROUP) & (F.col("m") <= SHINGLES), 1).otherwise(F.greatest(F.ceil(F.col("n") / (GROUP // 2)), F.ceil(F.col("m") / (SHINGLES // 2)))).cast("int").alias("c"))
    near = saved(near.join(chunks, "root").select("root", "node", "c"))
    wanted = near.join(nodes, "node").select("root", "node", "c", *names, "one.doc_id", "one.tx")
    held = texts.join(wanted, ["doc_id", "tx"]).dropDuplicates(["doc_id", "tx"]).select("root", "node", "c", *names, "text")
    held = held.mapInPandas(sets_of, ", ".join(["root long, node long, c int", *(f"{n} long" for n in names), "shingles binary"]))
    mine, other = F.pmod(F.xxhash64("node", F.lit(7)), F.col("c")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    dealt = held.withColumn("mine", mine).withColumn("other", other)
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = dealt.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node", *names, side.cast("int").alias("side"), "shingles")
    found = rows.repartition("g").sortWithinPartitions("g").mapInPandas(_alike(names, within, least), "a long, b long")
    roots = components(found).select("node", "root")
    named = nodes.select("node", F.col("one.doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.select("doc_id", "node").join(named.join(first, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """Rows of `docs`, with all its columns, whose doc_id names its own component of `near_copies`: one document of each group. Every row with a null doc_id stays, as a document of its own."""
    kept = near_copies(docs.select("doc_id", "text"), least, width).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
