"""MinHash near-duplicates: SuperMinHash signatures, bands, verified links, connected groups.

SuperMinHash gives each element of a set a random permutation of the registers and one random number for each step of it; in
step j the element puts j plus its number into the j-th register of its permutation, and each register keeps the least. So the
registers of one set are filled without replacement, which lowers the variance of the estimate, and a set is done as soon as all
its registers hold values of steps gone by: for sets well larger than the signature after two or three steps.

Signatures are cut into bands. Nodes (different sets) that share a band and whose signatures agree often enough make candidate
groups; in a group the full sets decide. Links are exact: a pair under the threshold is never linked, and a pair at 0.85 shares
none of the 25 bands of five in four cases of ten million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import BROADCAST, joined_by, saved, scratch, stored
from ductwise.llm.components import components
from ductwise.llm.simhash import shingle_set, whole_groups

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Nodes, and shingles, of one group that are compared in one place; a larger group is dealt out in chunks of half as many.
GROUP, SHINGLES = 4096, 1 << 22
#: Nodes of a large group that go to each of its chunks, so that chunks of near copies meet through them.
GUIDES = 8
#: Shingles whose signatures are made at once.
_BLOCK = 1 << 20
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash registers, a row for each set: the step in the highest byte, the random number below. A set without elements has the largest value everywhere."""
    if m > 256:
        raise ValueError("a step has one byte")
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = out.reshape(-1)
    x, of = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64), np.repeat(np.arange(len(sets)), size)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(x):
            break
        number = _mixed(x + np.uint64((2 * j + 1) * _STEP % 2**64)) >> np.uint64(8) | np.uint64(j << 56)
        at = (_mixed(x + np.uint64((2 * j + 2) * _STEP % 2**64)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)
        at = at.astype(np.int64) + j
        place = at.copy()  # what the swaps so far have brought to this place of the permutation
        for i in range(j - 1, -1, -1):
            k = swaps[i]
            place = np.where(place == k, i, np.where(place == i, k, place))
        np.minimum.at(flat, of * m + place, number)
        swaps.append(at)
        alive = out.max(axis=1) >= np.uint64(j + 1 << 56) if j < 255 else np.zeros(len(out), bool)
        left = alive[of]
        x, of, swaps = x[left], of[left], [k[left] for k in swaps]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = _mixed(key ^ parts[:, :, k]) + np.uint64(_STEP)
    return key


def _prints(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets, begin, held = [], 0, 0
            for i, text in enumerate(b["text"]):
                sets.append(shingle_set(text, width))
                held += len(sets[-1])
                if held >= _BLOCK or i + 1 == len(b):
                    part, sig = b.iloc[begin : i + 1], signatures(sets)
                    node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                    yield pd.DataFrame({
                        "doc_id": part["doc_id"].astype("Int64"), "tx": part["tx"], "node": node, "size": [len(s) for s in sets],
                        "bands": list(band_keys(sig).view(np.int64)), "sig": [x.tobytes() for x in (sig & np.uint64(255)).astype(np.uint8)],
                    })
                    sets, begin, held = [], i + 1, 0

    return run


def _sets(width: int):
    """The set of each node's text; of equal rows of a document that follow one another, one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            b = b.drop_duplicates("node")
            b = b[b["node"] != last]
            if len(b):
                last = b["node"].iloc[-1]
                yield b.assign(shingles=[shingle_set(t, width).tobytes() for t in b["text"]]).drop(columns="text")

    return run


def _merge(label: np.ndarray, i: int, j: np.ndarray) -> None:
    label[np.isin(label, label[j])] = label[i]


def _agree(floor: float, ratio: float):
    """Edges among nodes of one band that may be alike, by size and by the registers that agree, without pairs that earlier edges connect already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches):
            for _, b in whole.groupby("g", sort=False):
                b = b.sort_values("size", kind="stable")
                node, size, side = b["node"].to_numpy(), b["size"].to_numpy(), b["side"].to_numpy()
                sig = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), -1)
                label, x, y = np.arange(len(b)), [], []
                last = np.searchsorted(size, size / ratio + 1e-9, "right")  # larger sets that are not too large
                for i in range(len(b) - 1):
                    j = np.arange(i + 1, last[i])
                    j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 2))]
                    j = j[(sig[j] == sig[i]).mean(axis=1) >= floor] if len(j) else j
                    if len(j):
                        x.append(np.full(len(j), node[i]))
                        y.append(node[j])
                        _merge(label, i, j)
                yield pd.DataFrame({"a": np.concatenate([*x, node[:0]]), "b": np.concatenate([*y, node[:0]])})

    return run


def _alike(percent: int, floor: float):
    """Edges among nodes of one group whose full sets are alike: 100 * intersection >= percent * union. Pairs of one `known` label, and those that earlier edges connect, are left out."""

    def edges(b: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
        side, sets = b["side"].to_numpy(), [np.frombuffer(s, "<u8") for s in b["shingles"]]
        sig = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), -1)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        start, mark = np.cumsum(size) - size, np.zeros(len(values), bool)
        label, x, y = np.unique(b["known"].to_numpy(), return_inverse=True)[1], [], []
        for i in range(len(sets) - 1):
            j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            j = j[((side[j] != side[i]) | (side[j] == 2)) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            j = j[(sig[j] == sig[i]).mean(axis=1) >= floor] if len(j) else j
            if not len(j):
                continue
            mark[code[start[i] : start[i] + size[i]]] = True
            first = np.cumsum(size[j]) - size[j]
            both = np.add.reduceat(mark[code[np.repeat(start[j] - first, size[j]) + np.arange(size[j].sum())]], first, dtype=np.int64)
            mark[code[start[i] : start[i] + size[i]]] = False
            j = j[100 * both >= percent * (size[j] + size[i] - both)]
            if len(j):
                x.append(np.full(len(j), i))
                y.append(j)
                _merge(label, i, j)
        return x, y

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches):
            for _, b in whole.groupby("g", sort=False):
                b = b.drop_duplicates(["node", "side"])
                node, (x, y) = b["node"].to_numpy(), edges(b)
                none = np.zeros(0, np.int64)
                yield pd.DataFrame({"a": node[np.concatenate([*x, none])], "b": node[np.concatenate([*y, none])]})

    return run


def _chunk(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")


def candidates(nodes: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Edges (a, b) between nodes (node, size, bands, sig) that share a band and may be alike; pairs of one band that are connected already are left out.

    Bands that one node has alone are dropped before signatures move. A band of more than GROUP nodes is compared as pairs of
    chunks; there are at most bands / GROUP of those, and up to BROADCAST of them go to every executor, more are joined.
    """
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(keyed.join(met, "key"))
    large = saved(shared.where(F.col("n") > GROUP).select("key", "n").distinct())
    if large.isEmpty():
        dealt = shared.withColumn("g", F.col("key")).withColumn("side", F.lit(2))
    else:
        parts = F.coalesce(F.ceil(F.col("c") / (GROUP // 2)), F.lit(1)).cast("int")
        sized = large.select("key", F.col("n").alias("c"))
        dealt = shared.join(F.broadcast(sized) if large.count() <= BROADCAST else sized, "key", "left").withColumn("c", parts)
        dealt = dealt.withColumn("mine", _chunk("c", 7)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        dealt = dealt.withColumn("g", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", side)
    rows = dealt.select("node", "g", F.col("side").cast("int").alias("side")).join(nodes.select("node", "size", "sig"), "node")
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(_agree(floor, ratio), "a long, b long").distinct()


def _verified(rows: DataFrame, percent: int, floor: float) -> DataFrame:
    rows = rows.select("g", "node", "known", F.col("side").cast("int").alias("side"), "sig", "shingles")
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(_alike(percent, floor), "a long, b long")


def _chunks(n: Column, shingles: Column) -> Column:
    small = (n <= GROUP) & (shingles <= SHINGLES)
    return F.when(small, 1).otherwise(F.ceil(F.greatest(n / (GROUP // 2), shingles / (SHINGLES // 2)))).cast("int")


def _links(groups: DataFrame, split_any: bool, percent: int, floor: float) -> DataFrame:
    """Edges that connect all nodes of each group (root, c, guide, node, size, sig, shingles) that links connect.

    c is the number of chunks. A group of one chunk is compared in one place. Of a larger one each chunk is compared in itself and
    with the guides; what is then still apart from the group's largest part is compared with all of it. So a group of near
    copies costs in proportion to its rows, however large it is, and no pair is left out.
    """
    chunk = groups.withColumn("chunk", _chunk("c", 11))
    to = F.when((F.col("c") > 1) & F.col("guide"), F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array("chunk"))
    rows = chunk.withColumn("to", F.explode(to)).withColumn("g", F.xxhash64("root", "to"))
    found = saved(_verified(rows.withColumn("known", F.col("node")).withColumn("side", F.lit(2)), percent, floor).distinct())
    large = chunk.where("c > 1")
    if not split_any:
        return found
    part = large.select("root", "c", "node", "size").join(components(found).select("node", F.col("root").alias("known")), "node", "left")
    part = saved(part.withColumn("known", F.coalesce("known", "node")))
    parts = part.groupBy("root", "known").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    most = parts.groupBy("root").agg(F.max(F.struct("n", "m", "known")).alias("most"), F.sum("n").alias("n"), F.sum("m").alias("m")).where("most.n < n")
    r = F.ceil(F.greatest((F.col("n") - F.col("most.n")) / (GROUP // 2), (F.col("m") - F.col("most.m")) / (SHINGLES // 2))).cast("int")
    rest = most.select("root", F.col("most.known").alias("main"), F.greatest(r, F.lit(1)).alias("r"))
    split = part.select("root", "node", "known").join(rest, "root").join(chunk.select("node", "c", "chunk", "sig", "shingles"), "node")
    left = split.where("known <> main").withColumn("i", _chunk("r", 13)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("side", F.lit(0))
    right = split.withColumn("k", F.col("chunk")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("side", F.lit(1))
    return found.unionByName(_verified(left.unionByName(right.select(left.columns)).withColumn("g", F.xxhash64("root", "i", "k")), percent, floor)).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`; only doc_id and text are read, other columns may have any name.

    Two texts link if 100 * common >= percent * all over their sets of lower-cased (A-Z) word shingles; a text of fewer words than
    `width` is one shingle, one without words or null has none and links with nothing. Shingles stand by 64-bit hashes. component_id is the
    smallest doc_id reachable, `kept` says that it is the row's own. Texts of one set are one node, so copies cost one row each. Repeated
    doc_ids give a row each; a null doc_id is a row of its own that names no component with another id (component_id is null and
    kept true only where no id is reachable). No rows give no rows.
    """
    ratio, floor = percent / 100, max(0.0, percent / 100 - 0.2)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tx"))
    with scratch(docs.sparkSession) as path:
        fps = stored(texts.mapInPandas(_prints(width), "doc_id long, tx long, node long, size long, bands array<long>, sig binary"), f"{path}/prints")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("one")
        nodes = fps.where("size > 0").groupBy("node").agg(one, F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "bands", "sig")))
        nodes = stored(nodes, f"{path}/nodes")
        near = saved(components(candidates(nodes, floor, ratio)))
        members = nodes.select("node", "one", "size", "sig").join(near, "node")
        large = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("s")).withColumn("c", _chunks(F.col("m"), F.col("s"))).where("c > 1")
        large = saved(large.select("root", "m", "c"))
        few = large.count()
        members = members.join(F.broadcast(large) if few <= BROADCAST else large, "root", "left")
        guide = (F.col("c") > 1) & (F.pmod(F.xxhash64("node", F.lit(17)), F.col("m")) < GUIDES)
        wanted = members.select("root", "node", F.coalesce("c", F.lit(1)).alias("c"), F.coalesce(guide, F.lit(False)).alias("guide"), "size", "sig", F.col("one.doc_id").alias("d"), F.col("one.tx").alias("t"))
        held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t"))).select(*wanted.columns[:-2], "text")
        held = held.mapInPandas(_sets(width), "root long, node long, c int, guide boolean, size long, sig binary, shingles binary")
        edges = _links(stored(held, f"{path}/groups") if few else held, bool(few), percent, floor)
        named = nodes.select("node", F.col("one.doc_id").alias("first"), "n").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = saved(named)
        least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
        named = joined_by(named, least, "root", "nodes").select("node", "n", "component_id")
        found = joined_by(fps.where("size > 0").select("doc_id", "node", "size"), saved(named), "node", "n").select("doc_id", "size", "component_id")
        found = found.unionByName(fps.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
        return saved(found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
