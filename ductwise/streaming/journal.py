"""The event journal as a stream: files of JSON lines in, counts and the rows after a place out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, at timestamp, event string, run_id string, payload string"


def stream(spark: SparkSession, path: str, files: int = 100, late: str = "30 minutes") -> DataFrame:
    """Journal events as they arrive; at most `files` new files to a batch. Events later than `late` may be left out by what follows."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path).withWatermark("at", late)


def after(events: DataFrame, seq: int) -> DataFrame:
    """Incremental read: events later than the last one seen."""
    return events.where(F.col("seq") > seq)


def counts(events: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time; those later than the watermark are left out."""
    return events.groupBy(F.window("at", window), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def once(events: DataFrame) -> DataFrame:
    """Each (run_id, seq) once, however often its line was written."""
    return events.dropDuplicatesWithinWatermark(["run_id", "seq"]) if events.isStreaming else events.dropDuplicates(["run_id", "seq"])
