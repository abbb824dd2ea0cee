"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file set is a folder with `tokens/shard=N/*.parquet` and `ranks/*.parquet`. A row of `tokens` is a block of consecutive
documents: `first_seq`, `doc_ids`, `counts` (ids of each document, the end id included), `control` and `data`. Ids are
replaced by their rank (0 = most frequent in the whole corpus); a rank takes 1 to 4 data bytes, little end first, and a
two-bit length code, four codes to a control byte. Shards ascend in doc_id, and so do the rows of a shard. Parquet is only
the container: Spark's writer commits it safely on any store and a lost executor's part is written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.llm.common import new_folder, remove, scratch, stored, tokenizer

#: Ids that a block holds before the next one begins.
BLOCK_IDS = 1 << 18
#: For each control byte, the data bytes of its four codes.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks; nothing for no ranks."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    if int(r.max(initial=0)) <= 0xFFFF:  # the usual case, with half the bytes to look at
        code = (r > 0xFF).astype(np.uint8)
        keep = np.ones((len(r), 2), bool)
        keep[:, 1] = code
        data = r.astype("<u2").view(np.uint8)[keep.ravel()]
    else:
        code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
        data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of `encode`, by table lookup of the lengths and offsets."""
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lens, dtype=np.int64)
    starts -= lens
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lens.max(initial=1))):
        more = np.flatnonzero(lens > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(path: str, end_id: int):
    """Ids of each document, and last for the partition a row with seq -1 that holds how often it has each id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end, seq, shard = tokenizer(path, "byte"), np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        total = np.zeros(0, np.int64)
        for b in batches:
            raw = [tok.ids(t) + end for t in b["text"]]
            n = [len(x) // 4 for x in raw]
            ids = np.frombuffer(b"".join(raw), "<u4")
            c = np.bincount(ids)
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
            if len(total) <= 1 << 16:
                short, at = ids.astype("<u2").tobytes(), np.append(0, np.cumsum(n) * 2).tolist()
                raw = [short[i:j] for i, j in zip(at, at[1:])]
            yield pd.DataFrame({"shard": shard, "seq": np.arange(seq, seq + len(b)), "doc_id": b["doc_id"].astype("Int64"), "n": n, "ids": raw})
            seq += len(b)
        yield pd.DataFrame({"shard": [shard], "seq": [-1], "doc_id": pd.array([None], "Int64"), "n": [0], "ids": [total.astype("<i8").tobytes()]})

    return run


def _wide_all(raw: list[bytes], n: list[int]) -> np.ndarray:
    """Ids of several documents, each stored with two or four bytes to an id."""
    raw, n = list(raw), list(n)
    if sum(map(len, raw)) == 2 * sum(n):
        return np.frombuffer(b"".join(raw), "<u2")
    return np.concatenate([np.frombuffer(r, "<u2" if len(r) == 2 * k else "<u4").astype(np.uint32) for r, k in zip(raw, n, strict=True)])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["ids"]:
            n = np.frombuffer(raw, "<i8")
            at = np.flatnonzero(n)
            yield pd.DataFrame({"id": at, "n": n[at]})


def _blocks(rank_of: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            control, data = encode(rank_of[_wide_all([x[4] for x in held], [x[3] for x in held])])
            return pd.DataFrame({"shard": [held[0][0]], "first_seq": [held[0][1]], "doc_ids": [[x[2] for x in held]], "counts": [[x[3] for x in held]], "control": [control], "data": [data]})

        for b in batches:
            for row in zip(b["shard"], b["seq"], b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["n"], b["ids"], strict=True):
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + 1 or size >= BLOCK_IDS):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield out()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> str:
    """Tokenises whole texts (null: empty) and writes a file set in ascending doc_id order; returns its folder.

    Every document takes its ids and then end_id. Null ids come first; equal ids follow each other in the order of their
    texts. An empty table gives a file set without blocks. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    with scratch(spark) as raw:
        ids = stored(ordered.mapInPandas(_tokenise(tokenizer_path, end_id), "shard int, seq long, doc_id long, n int, ids binary"), raw)
        counted = ids.where("seq = -1").select("ids").mapInPandas(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
        order = np.array([r["id"] for r in counted], np.int64)
        spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
        rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
        rank_of[order] = np.arange(len(order), dtype=np.uint32)
        blocks = ids.where("seq >= 0").mapInPandas(_blocks(rank_of), "shard int, first_seq long, doc_ids array<long>, counts array<int>, control binary, data binary")
        blocks.sortWithinPartitions("shard", "first_seq").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/tokens")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, seq, doc_id, n_tokens, ids_crc32, ids) of a file set; `ids` as little-endian unsigned 32-bit integers."""
    order = np.array([r["id"] for r in spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, x in b.iterrows():
                n = np.asarray(x["counts"], np.int64)
                ids = order[decode(x["control"], x["data"], int(n.sum()))].astype("<u4")
                parts = [p.tobytes() for p in np.split(ids, np.cumsum(n)[:-1])]
                yield pd.DataFrame({"shard": x["shard"], "seq": np.arange(x["first_seq"], x["first_seq"] + len(n)), "doc_id": pd.array([None if v is None or v != v else int(v) for v in x["doc_ids"]], "Int64"), "n_tokens": n, "ids_crc32": [zlib.crc32(p) for p in parts], "ids": parts})

    blocks = spark.read.schema("first_seq long, doc_ids array<long>, counts array<int>, control binary, data binary, shard int").parquet(f"{path}/tokens")
    return blocks.mapInPandas(run, "shard int, seq long, doc_id long, n_tokens long, ids_crc32 long, ids binary")


def placed(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before each, to rows of `read`. Only one total for each shard goes to the driver."""
    rows = rows.drop("ids")
    base, at = {}, 0
    for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        base[r["shard"]], at = at, at + r["n"]
    shards = rows.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "shard int, base long")
    before = W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("base")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from a file set written in the shared folder."""
    from ductwise.llm.common import saved

    path = write(docs, new_folder(docs.sparkSession, "tokens"), tokenizer_path, end_id)
    rows = saved(read(docs.sparkSession, path).drop("ids"))
    remove(docs.sparkSession, path)
    return placed(rows.withColumn("ids", F.lit(None))).select("doc_id", "start", "n_tokens", "ids_crc32")
