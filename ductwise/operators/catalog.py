"""Datasets, versions, edits and retention over plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.operators import trees


@dataclass(frozen=True)
class Add:
    """Rows to add; columns of the table."""

    rows: DataFrame


@dataclass(frozen=True)
class Remove:
    """Ids of rows to take out."""

    ids: DataFrame


@dataclass(frozen=True)
class Set:
    """(fid, value): what the attribute becomes; null takes it away."""

    attribute: str
    values: DataFrame


def apply_edits(rows: DataFrame, edits: Sequence[Add | Remove | Set], key: str = "fid") -> DataFrame:
    """A new version of a table: the edits one after the other, so of two on one attribute the last holds."""
    for e in edits:
        if isinstance(e, Add):
            rows = rows.unionByName(e.rows, allowMissingColumns=True)
        elif isinstance(e, Remove):
            rows = rows.join(e.ids.select(key).distinct(), key, "left_anti")
        else:
            new = e.values.select(key, F.col("value").alias("_value"), F.lit(True).alias("_set"))
            rows = rows.join(new, key, "left").withColumn(e.attribute, F.when(F.col("_set"), F.col("_value")).otherwise(F.col(e.attribute))).drop("_value", "_set")
    return rows


def missing(ids: DataFrame, rows: DataFrame, key: str = "fid") -> DataFrame:
    """Ids of an edit that the table does not hold; an edit on one of them is an error."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti")


def families(versions: DataFrame) -> DataFrame:
    """(root_id, n, newest, next_version) of each family of versions (id, parent_id, version); null parents are roots. Versions whose parents go round in a circle are one family without a root."""
    top = trees.climb(versions, node="id", parent="parent_id").select(F.col("node").alias("id"), F.col("top").alias("root_id"))
    return versions.join(top, "id").groupBy("root_id").agg(F.count("*").alias("n"), F.max("id").alias("newest"), (F.max("version") + 1).cast("long").alias("next_version"))


def descendants(versions: DataFrame, root: int) -> DataFrame:
    """Ids of a version and all that come from it, each once; parents may go round in a circle."""
    cut = versions.select("id", F.when(F.col("id") != root, F.col("parent_id")).alias("parent_id"))
    return trees.climb(cut, node="id", parent="parent_id").where(F.col("top") == root).select(F.col("node").alias("id"))


def expired(runs: DataFrame, keep: int, hours: int, now: Column) -> DataFrame:
    """Runs to delete: not pinned, not among the newest `keep` unpinned of their dataset, and older than `hours`."""
    newest = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    old = F.col("created_at") < now - F.make_dt_interval(hours=F.lit(hours))
    return runs.where("not pinned").withColumn("_r", newest).where((F.col("_r") > keep) & old).drop("_r")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Per code: the first severity by name, all issues, and those that name a feature."""
    return issues.groupBy("code").agg(F.min("severity").alias("severity"), F.count("*").alias("n"), F.count("feature_id").alias("n_features"))


def inherited_issues(issues: DataFrame, removed: DataFrame) -> DataFrame:
    """Issues that a new version takes over: none about edits, none of removed features."""
    return issues.where(~F.col("code").like("edit.%")).join(removed.select(F.col("fid").alias("feature_id")), "feature_id", "left_anti")


def with_examples(issues: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` issues of each code, in order, each with the full count of its code."""
    w = W.partitionBy("code").orderBy("seq", "feature_id")
    counts = issues.groupBy("code").agg(F.count("*").alias("n"))
    return issues.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r").join(F.broadcast(counts), "code")


def features_by_id(rows: DataFrame, fid: object, key: str = "fid", order: str = "seq", most: int = 100) -> DataFrame:
    """The first `most` rows of one id, in order: a point lookup that reaches the scan as a filter."""
    return rows.where(F.col(key) == fid).orderBy(order).limit(most)


def features_of_issue(rows: DataFrame, issues: DataFrame, code: str, key: str = "fid", order: str = "seq", most: int = 5000) -> DataFrame:
    """The first `most` rows that an issue of this code names."""
    named = issues.where(F.col("code") == code).select(F.col("feature_id").alias(key))
    return rows.join(named, key, "left_semi").orderBy(order).limit(most)


def filtered_issues(issues: DataFrame, severity: str | None = None, most: int = 500) -> DataFrame:
    """The first `most` issues of a severity by code, or of all by severity and code; ties in order of seq."""
    found = issues if severity is None else issues.where(F.col("severity") == severity)
    return found.orderBy(*([] if severity else ["severity"]), "code", "seq").limit(most)


def copy_version(rows: DataFrame, parent: object, child: object, version: str = "dataset_id") -> DataFrame:
    """The rows of one version as those of a new one."""
    return rows.where(F.col(version) == parent).withColumn(version, F.lit(child))


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str = "fid", value: str = "geom") -> DataFrame:
    """Adds `value` from `first`, and where that has none from `second`; both hold (key, value), at most one row for a key."""
    a, b = first.select(key, F.col(value).alias("_first")), second.select(key, F.col(value).alias("_second"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")


def run_scores(runs: DataFrame, summary: str = "summary") -> DataFrame:
    """Adds best_score and variants from a JSON array of variants with their scores; no array gives null and null."""
    found = F.from_json(summary, "array<struct<score double>>")
    return runs.withColumns({"best_score": F.array_min(F.transform(found, lambda x: x.score)), "variants": F.when(found.isNotNull(), F.size(found))})


def nearest_rank(value: str, percent: int) -> Column:
    """The smallest value that at least `percent` in a hundred do not exceed; from counts of different values, so it is summed before the shuffle."""
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {value})")
