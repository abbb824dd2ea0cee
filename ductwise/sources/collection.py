"""One JSON document of many features, read by many tasks.

Spark splits text at any separator, so the document is read in records that end with a closing brace. What a record is depends on all
before it: whether it begins inside a string, and how deep. A first pass over the file sums up each split of it for both cases,
a short table of one row a split carries them on from split to split, and then each split is cut into features, knowing how it
begins. A feature that goes over the edge of a split is put together from its pieces, for which the file is cut once more (three passes
in all, where storing what was cut would write the whole input). No task sees more than its split and one feature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.session import cut_lineage

#: An escaped character, a quote, or a bracket.
TOKEN = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
#: Open brackets around a feature: those of the document and of its list.
OUTER = 2
#: Splits whose beginnings go to every task, some 100 bytes each; with splits of 128 MB these are 128 TB.
MOST_SPLITS = 1 << 20
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def steps(text: str) -> tuple[int, int, int]:
    """(quotes, outside, inside): how many quotes count, and by how much the depth grows if the text begins outside of a string, or inside."""
    quotes, depth = 0, [0, 0]
    for token in TOKEN.findall(text):
        if token == '"':
            quotes += 1
        elif len(token) == 1:
            depth[quotes % 2] += _STEP[token]
    return quotes, depth[0], depth[1]


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each split in a batch; a later sum needs their order in the split, as a quote turns what follows."""
    for batch in batches:
        rows, last = [], None
        for file, block, text in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if last != (file, block):
                rows.append([file, block, len(rows), 0, 0, 0])
                last = (file, block)
            quotes, *depth = steps(text + "}")
            odd = rows[-1][3] % 2
            rows[-1][3] += quotes
            rows[-1][4] += depth[odd]
            rows[-1][5] += depth[1 - odd]
        yield pd.DataFrame(rows, columns=["file", "block", "part", "quotes", "outside", "inside"])


def _chained(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `odd` and `depth` before each of them, in order; the table holds a row for each split or batch, not for each feature."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    return rows.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))


class _Cutter:
    """Cuts the records of one split into features; keeps the depth, and the text of the feature that is open."""

    def __init__(self, odd: bool, depth: int) -> None:
        self.odd, self.depth = odd, depth
        self.open: list[str] | None = [] if depth > OUTER else None  # None: no feature is open
        self.head = depth > OUTER  # the open one began in an earlier split

    def take(self, text: str) -> Iterator[tuple[str, str]]:
        start = 0
        for m in TOKEN.finditer(text):
            token = m.group()
            if token == '"':
                self.odd = not self.odd
            elif len(token) == 1 and not self.odd:
                if _STEP[token] > 0:
                    if self.depth == OUTER:
                        self.open, start = [], m.start()
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.depth == OUTER and self.open is not None:
                        yield ("head" if self.head else "whole"), "".join(self.open) + text[start : m.end()]
                        self.open, self.head = None, False
        if self.open is not None:
            self.open.append(text[start:])

    def rest(self) -> Iterator[tuple[str, str]]:
        if self.open:
            yield ("through" if self.head else "tail"), "".join(self.open)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, now, cutter, number = ["file", "block", "number", "kind", "text"], None, None, 0
    for batch in batches:
        rows = []
        for file, block, odd, depth, text in zip(batch["file"], batch["block"], batch["odd"], batch["depth"], batch["value"], strict=True):
            if now != (file, block):
                rows += [(*now, number + i, *r) for i, r in enumerate(cutter.rest())] if cutter else []
                now, cutter, number = (file, block), _Cutter(odd, depth), 0
            for found in cutter.take(text + "}"):
                rows.append((*now, number, *found))
                number += 1
        yield pd.DataFrame(rows, columns=names)
    if cutter:
        yield pd.DataFrame([(*now, number + i, *r) for i, r in enumerate(cutter.rest())], columns=names)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text up to each closing brace, which is left out, in the order of the file within a split."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, text): every object in the lists of the document's members, as JSON text; (file, block, number) is the order of the document.

    For a FeatureCollection these are its features; objects two levels down in other members come too and are told apart by their `type`.
    A file without such objects has no rows. The document must be sound JSON; a file that is cut short loses the feature that is cut. Its
    splits are those of spark.sql.files.maxPartitionBytes; compressed files have one.
    """
    found = records(spark, path)
    summed = found.mapInPandas(_summed, "file string, block long, part long, quotes long, outside long, inside long")
    summed = summed.withColumn("part", F.monotonically_increasing_id())  # a split lies in one task, its batches in order
    split = _chained(summed, ["file", "block"], ["part"])
    # turned as a whole if the split begins inside a string
    other = F.when(F.col("odd"), F.col("outside")).otherwise(F.col("inside"))
    split = split.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("own").alias("outside"), F.sum(other).alias("inside"))
    begins = _chained(split, ["file"], ["block"]).select("file", "block", "odd", "depth")
    begins = cut_lineage(begins)
    if begins.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes, or read the files in several lots")
    cut = found.join(F.broadcast(begins), ["file", "block"]).mapInPandas(_cut, "file string, block long, number long, kind string, text string")
    edges = cut.where("kind <> 'whole'")
    so_far = W.partitionBy("file").orderBy("block", "number").rowsBetween(W.unboundedPreceding, 0)
    edges = edges.withColumn("_f", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(so_far))
    piece = F.struct("block", "number", "text", "kind")
    put = edges.groupBy("file", "_f").agg(F.array_sort(F.collect_list(piece)).alias("_p")).where(F.exists("_p", lambda p: p.kind == "head"))
    put = put.select("file", F.col("_p")[0].block.alias("block"), F.col("_p")[0].number.alias("number"), F.array_join(F.transform("_p", lambda p: p.text), "").alias("text"))
    return cut.where("kind = 'whole'").select("file", "block", "number", "text").unionByName(put)
