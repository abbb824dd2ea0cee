"""Comparison of variants, parameters and edit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_table(rows: DataFrame, key: str, a: str, b: str, metrics: list[str], slack: float = 1e-9) -> DataFrame:
    """(metric, a, b, delta, better) of two variants; the lower value is better, equal ones to a relative slack are `same`."""
    long = rows.where(F.col(key).isin(a, b)).unpivot(key, metrics, "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(key) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(key) == b, F.col("value"))).alias("b"))
    delta = F.col("b") - F.col("a")
    close = F.abs(delta) <= slack * F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0))
    return wide.select("metric", "a", "b", F.round(delta, 4).alias("delta"), F.when(close, "same").when(delta > 0, "a").otherwise("b").alias("better"))


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with `side`: only_a, only_b or common; a and b have the same columns and no repeats."""
    on = a.columns
    parts = {"only_a": a.join(b, on, "left_anti"), "only_b": b.join(a, on, "left_anti"), "common": a.join(b, on, "left_semi")}
    out = None
    for name, part in parts.items():
        part = part.withColumn("side", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, before, after) of attributes that differ, a null being a value of its own; keys in both tables."""
    b = before.unpivot(key, columns, "name", "before")
    a = after.unpivot(key, columns, "name", "after")
    return b.join(a, [key, "name"]).where(~F.col("before").eqNullSafe(F.col("after")))
