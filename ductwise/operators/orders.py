"""Orders in which consumers and tie-ins are tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def three_orders(df: DataFrame, keys: list[str], distance: str, flow: str, key: str) -> DataFrame:
    """Adds near, far and by_flow, places from 1: nearest first with ties by id, the reverse of that, and the largest flow first with ties as in near."""
    near, far = [F.col(distance), F.col(key)], [F.desc(distance), F.desc(key)]
    place = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"near": place(near), "far": place(far), "by_flow": place([F.desc(flow), *near])})


def group_orders(df: DataFrame, group: str, distance: str, flow: str, key: str, most: int = 6) -> DataFrame:
    """(group, orders): for each group of 2 to `most` consumers its different orders among far, by flow and near, as arrays of ids.

    Larger groups have no row, so an array holds `most` ids at most; they are left out before ids are gathered.
    """
    small = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most)).select(group)
    rows = df.join(small, group, "left_semi").groupBy(group).agg(F.collect_list(F.struct(F.col(distance).alias("d"), F.col(key).alias("id"), (-F.col(flow)).alias("f"))).alias("_c"))
    ids = lambda a: F.transform(a, lambda c: c.id)
    near = F.array_sort("_c")
    by_flow = F.transform(F.array_sort(F.transform("_c", lambda c: F.struct(c.f.alias("f"), c.d.alias("d"), c.id.alias("id")))), lambda c: c.id)
    return rows.select(group, F.array_distinct(F.array(F.reverse(ids(near)), by_flow, ids(near))).alias("orders"))


def alternatives(df: DataFrame, key: str, option: str, score: str, chosen: str, most: int = 6) -> DataFrame:
    """The `most` options of each key with the lowest score, ties by option; a chosen one further back takes the last place."""
    w = W.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(score, option)))
    ranked = ranked.withColumn("_c", F.max(F.when(F.col(chosen), F.col("_r"))).over(w))
    last = F.when(F.col("_c") > most, most - 1).otherwise(most)
    return ranked.where((F.col("_r") <= last) | F.col(chosen)).withColumn("place", F.least("_r", F.lit(most))).drop("_r", "_c")
