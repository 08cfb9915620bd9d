"""The audit as Structured Streaming: running statistics by tool and error counts by time window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.audit import tool_stats
from lodeworks.sources.shared import shared_root

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_stats(calls: DataFrame) -> DataFrame:
    """Statistics by tool; "last" is by sequence, so late events never overwrite newer ones and need no watermark."""
    return tool_stats(calls)


def error_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Errors by window of event time; events later than the watermark are dropped with their window's state."""
    rows = events.withWatermark("ts", late).where("event_type = 'error'")
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("errors")).select(F.col("w.start").alias("window_start"), "errors")


def drain(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over all that is there and return its result: the last row of each key.

    Each batch writes the rows that it changed (update mode, so a watermark lets state go) to the shared folder, under its
    number: a batch that runs again writes over itself.  State and progress go there too.
    """
    root = f"{shared_root(stream.sparkSession)}/drained-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*stream.columns)
