"""The audit's state as a snapshot and the events after it: each load folds only what is new into what is stored.

A snapshot is one commit of a folder: counts by tool, the newest calls, and the sequence number up to which events are in it.  A load
reads the events beyond that number (a filter that reaches their scan), merges, and replaces the snapshot in one commit, so a
load that fails leaves the old one, and one that comes again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources import committed

STATS = ["total", "success", "failure"]
LASTS = {"success": ["seq", "at_ms"], "failure": ["seq", "at_ms", "error_kind"]}
KEPT = 1000


def _counted(calls: DataFrame) -> DataFrame:
    """calls (seq, tool, ok, at_ms, error_kind) -> a row for each tool: counts, and the last success and failure by sequence."""
    last = lambda ok, fields: F.max(F.when(ok, F.struct(*fields)))
    return calls.groupBy("tool").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), last(F.col("ok"), LASTS["success"]).alias("last_success"), last(~F.col("ok"), LASTS["failure"]).alias("last_failure"))


def _rows(part: str, upto: int, stats: DataFrame | None, recent: DataFrame | None) -> DataFrame:
    """Rows of one part of a snapshot, in the form of both."""
    if stats is not None:
        return stats.select(F.lit(part).alias("part"), F.lit(upto).cast("long").alias("upto"), F.struct("tool", *STATS, "last_success", "last_failure").alias("stats"), F.lit(None).cast("struct<seq: bigint, tool: string, ok: boolean, at_ms: bigint, error_kind: string>").alias("call"))
    kind = "struct<tool: string, total: bigint, success: bigint, failure: bigint, last_success: struct<seq: bigint, at_ms: bigint>, last_failure: struct<seq: bigint, at_ms: bigint, error_kind: string>>"
    return recent.select(F.lit(part).alias("part"), F.lit(upto).cast("long").alias("upto"), F.lit(None).cast(kind).alias("stats"), F.struct("seq", "tool", "ok", "at_ms", "error_kind").alias("call"))


def load(spark: SparkSession, path: str, events: DataFrame, keep: int = KEPT) -> None:
    """Fold the events (seq, tool, ok, at_ms, error_kind) that the snapshot does not have into it; seq only grows."""
    there = bool(committed.Folder(path).current())
    upto = (committed.load(spark, path).agg(F.max("upto")).first()[0] if there else None) or -1
    fresh = events.select("seq", "tool", "ok", F.col("at_ms").cast("long").alias("at_ms"), F.col("error_kind").cast("string").alias("error_kind")).where(F.col("seq") > upto)
    newest = fresh.agg(F.max("seq")).first()[0]
    if newest is None:
        return
    fresh = fresh.where(F.col("seq") <= newest)  # what arrives meanwhile is the next load's
    stats, recent = _counted(fresh), fresh.orderBy(F.desc("seq")).limit(keep)
    if there:
        merged = stats.unionByName(committed.load(spark, path, part="stats").select("stats.*")).groupBy("tool")
        stats = merged.agg(*(F.sum(c).alias(c) for c in STATS), F.max("last_success").alias("last_success"), F.max("last_failure").alias("last_failure"))
        recent = recent.unionByName(committed.load(spark, path, part="recent").select("call.*")).orderBy(F.desc("seq")).limit(keep)
    committed.save(_rows("stats", newest, stats, None).unionByName(_rows("recent", newest, None, recent)), path, by="part", mode="overwrite")
    committed.vacuum(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tool: its counts, last success and failure, and how many of the newest calls are its."""
    stats = committed.load(spark, path, part="stats").select("stats.*")
    recent = committed.load(spark, path, part="recent").groupBy(F.col("call.tool").alias("tool")).agg(F.count("*").alias("in_recent"))
    return stats.join(recent, "tool", "left").select("tool", *STATS, F.col("last_success.at_ms").alias("last_success_ms"), F.col("last_failure.at_ms").alias("last_failure_ms"), F.coalesce("in_recent", F.lit(0)).alias("in_recent"))
