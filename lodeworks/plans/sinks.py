"""Registered queries of the sinks: written to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.registry import query
from lodeworks.sources import committed, sinks
from lodeworks.sources.shared import shared_root
from lodeworks.sources.tables import table
from lodeworks.streaming.audit_stream import event_stream


def _calls(events: DataFrame) -> DataFrame:
    """Tool calls out of events, with secrets in their payloads and errors."""
    n = F.col("user_id")
    payload = F.to_json(F.struct(n.alias("user"), F.struct(F.concat(F.lit("k"), n).alias("api_key"), F.array(F.struct(F.lit("t").alias("access_token"), F.lit("https://u:p@h.example/x").alias("url"))).alias("list")).alias("inner")))
    ok = F.col("event_type") != "error"
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("tool"), n % 7).alias("tool"), ok.alias("ok"), F.col("ts").cast("timestamp").alias("at"), F.when(~ok, F.lit("failed at https://me:secret@h.example/y")).alias("error"), payload.alias("payload"))


SQL_RECORDS = """SELECT event_id AS seq, 'tool' || user_id % 7 AS tool, event_type <> 'error' AS ok, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN 'failed at https://***@h.example/y' END AS error,
  '{"user":' || user_id || ',"inner":{"api_key":"***","list":[{"access_token":"***","url":"https://***@h.example/x"}]}}' AS payload FROM events"""


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("t21_audit_records", SQL_RECORDS)
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a committed folder, redacted, run twice: the second run has nothing to add."""
    path = _path(spark, "audit")
    for _ in range(2):
        sinks.stream_audit(_calls(event_stream(spark, f"{sf_dir}/events.parque[t]")), path, "calls", f"{path}-progress").awaitTermination()
    return committed.load(spark, path).select("seq", "tool", "ok", "day", "error", "payload")


@query("a30_audit_export", f"WITH r AS ({SQL_RECORDS}) SELECT seq, tool, ok, error, payload FROM r WHERE day IN (SELECT min(day) FROM r UNION ALL SELECT max(day) FROM r)")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last day's records as JSON lines, read back."""
    path, out = _path(spark, "audit"), _path(spark, "audit-lines")
    sinks.append_audit(_calls(table(spark, sf_dir, "events")), path)
    first, last = committed.manifest_files(spark, path).agg(F.min("values.day"), F.max("values.day")).first()
    for day in {first, last}:
        sinks.export_jsonl(spark, path, out, [day])
    return spark.read.schema("seq long, tool string, ok boolean, error string, payload string").json(out)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three artifacts a page, of ten documents: written, filtered with a reason, failed."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "html")
    status = F.element_at(F.array(*map(F.lit, ("written", "filtered", "error", "written"))), ((F.col("page") + F.col("i")) % 4 + 1).cast("int"))
    kind = F.when(F.col("i") == 0, "table").otherwise("image")
    name = F.format_string("p%04d_%s_%02d", F.col("page"), kind, F.col("i"))
    reason = F.when(status == "filtered", "too_few_columns").when(status == "error", "no content")
    return rows.select((F.col("page") % 10).alias("doc_id"), "page", kind.alias("kind"), name.alias("name"), F.when(status == "written", F.concat(F.col("i"), F.col("html"))).alias("content"), status.alias("status"), reason.alias("reason"))


SQL_CANDIDATES = "c AS (SELECT page_id % 10 AS doc_id, page_id AS page, i, html, ['written', 'filtered', 'error', 'written'][(page_id + i) % 4 + 1] AS status, CASE WHEN i = 0 THEN 'table' ELSE 'image' END AS kind FROM pages, range(3) t(i))"


@query("a32_artifact_totals", f"WITH {SQL_CANDIDATES} SELECT doc_id, page, count(*) AS candidates, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'error') AS errors, grouping(page)::INT AS whole FROM c GROUP BY GROUPING SETS ((doc_id), (doc_id, page))")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved in two overlapping parts, the second of them twice."""
    path, rows = _path(spark, "artifacts"), _candidates(spark, sf_dir)
    for part in (rows.where("page % 3 < 2"), rows, rows):
        sinks.save_artifacts(part, path)
    return sinks.artifact_totals(spark, path)


@query("a31_artifact_contents", f"WITH {SQL_CANDIDATES} SELECT doc_id, page, kind, format('p{{:04d}}_{{}}_{{:02d}}', page, kind, i) AS name, sha256(i || html) AS sha256, true AS intact FROM c WHERE status = 'written' AND kind = 'image'")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one kind of artifacts: only its files are read."""
    path = _path(spark, "artifacts")
    sinks.save_artifacts(_candidates(spark, sf_dir), path)
    return sinks.read_artifacts(spark, path, "image").select("doc_id", "page", "kind", "name", "sha256", "intact")
