"""Incremental ingest: new files become documents and chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsight.operators.sections import load_documents


def filing_stream(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Documents of files that arrive in a folder, by the same transformations as in batch."""
    files = spark.readStream.option("pathGlobFilter", glob).text(path, wholetext=True)
    return load_documents(files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")))


def ingest_stream(documents: DataFrame, ingest: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Feeds each micro-batch to ``ingest``, whose ids are deterministic, so a repeated batch changes nothing; ends when all files are read."""

    def batch(df: DataFrame, number: int) -> None:
        ingest(df.withColumn("doc_id", F.concat_ws("#", "source_file", "section")))

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of re-deliverable events by time window and type; repeated ids within ``late`` count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
