"""Sinks on committed folders: audit records that are redacted before they are written, and artifacts with a manifest of what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.urls import redact_credentials
from lodeworks.operators.artifacts import manifest_totals
from lodeworks.operators.audit import redact_json
from lodeworks.sources import committed

RECORD = ["seq", "tool", "ok", "at", "error", "payload"]
ARTIFACT = ["doc_id", "page", "kind", "name"]


def audit_records(calls: DataFrame) -> DataFrame:
    """calls (seq, tool, ok, at, error, payload JSON) with day, without secrets: secret keys' values at any depth, and credentials in addresses."""
    safe = redact_credentials(redact_json(F.col("payload")))
    return calls.select("seq", "tool", "ok", "at", redact_credentials(F.col("error")).alias("error"), safe.alias("payload"), F.date_format("at", "yyyy-MM-dd").alias("day"))


def append_audit(calls: DataFrame, path: str) -> None:
    committed.save(audit_records(calls), path, by="day")


def stream_audit(calls: DataFrame, path: str, name: str, progress: str):
    """calls as a stream, to the same folder; a batch that comes again (same name and number) counts once.  The started query."""
    committed.register(calls.sparkSession)
    writer = audit_records(calls).writeStream.format("committed").option("path", path).option("by", "day").option("stream", name)
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start()


def export_jsonl(spark: SparkSession, path: str, out: str, days: list[str] | None = None) -> None:
    """A JSON line for each record of a folder, appended to out: only the days that are asked for are read."""
    records = committed.load(spark, path) if days is None else committed.load(spark, path, day=days)
    records.select(F.to_json(F.struct(*RECORD), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(out)


class ArtifactsExistError(ValueError):
    pass


def save_artifacts(candidates: DataFrame, path: str) -> None:
    """candidates (doc_id, page, kind, name, content, status, reason): the written ones' contents, then what became of each.

    A name that has another content already is refused before anything is written.  What is there with the
    same content is left alone, so a save that failed between the two steps can be repeated: one copy results.
    """
    spark = candidates.sparkSession
    rows = candidates.withColumn("sha256", F.when(F.col("status") == "written", F.sha2(F.col("content").cast("binary"), 256)))
    wanted = rows.where("status = 'written'").select(*ARTIFACT, "content", "sha256")
    decided = rows.select(*ARTIFACT, "status", "reason", "sha256")
    key = ["doc_id", "name"]
    if wanted.groupBy(*key).agg(F.count_distinct("sha256").alias("n")).where("n > 1").limit(1).count():
        raise ArtifactsExistError("one name stands for several contents")
    if committed.Folder(f"{path}/files").current():
        there = committed.load(spark, f"{path}/files").select(*key, F.col("sha256").alias("known"))
        met = wanted.join(there, key, "left")
        if clash := met.where("known <> sha256").limit(1).collect():
            raise ArtifactsExistError(f"artifact {clash[0]['name']} of document {clash[0]['doc_id']} exists with another content")
        wanted = met.where("known is null").drop("known")
        done = committed.load(spark, f"{path}/decisions") if committed.Folder(f"{path}/decisions").current() else None
        if done is not None:
            decided = decided.join(done.select(*ARTIFACT), ARTIFACT, "left_anti")
    committed.save(wanted.dropDuplicates(key), f"{path}/files", by="kind")
    committed.save(decided, f"{path}/decisions")


def artifact_totals(spark: SparkSession, path: str) -> DataFrame:
    """Candidates, written, filtered and failed by document and page, from a folder's decisions."""
    return manifest_totals(committed.load(spark, f"{path}/decisions"), "doc_id", "page")


def read_artifacts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The contents that were written, with their digest as a check: intact."""
    files = committed.load(spark, f"{path}/files") if kind is None else committed.load(spark, f"{path}/files", kind=kind)
    return files.withColumn("intact", F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256"))
