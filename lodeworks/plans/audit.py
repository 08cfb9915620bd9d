"""Registered queries of the tool-call audit, cache eviction and key rotation, over events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import audit as A
from lodeworks.operators import audit_state
from lodeworks.plans.registry import query
from lodeworks.sources.shared import shared_root
from lodeworks.sources.tables import live_entry, put_entries, table, values

SQL_EVENTS = "e AS (SELECT event_id AS seq, 'tool' || (user_id % 7) AS tool, event_type <> 'error' AS ok, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'provider' WHEN 2 THEN 'parse' ELSE 'other' END END AS error_kind FROM events)"
SQL_CACHE = "c AS (SELECT 'k' || lpad(doc_id::VARCHAR, 8, '0') AS cache_key, 1700000000 + (doc_id * 37) % 500 AS updated_at, n_chars AS size_bytes, CASE WHEN doc_id % 3 <> 0 THEN 1700000000 + (doc_id * 91) % 1000 END AS expires_at FROM documents)"
NOW = 1_700_000_400


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: errors are failures, two thirds of them with a kind."""
    e = table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 != 0), F.get(F.array(*map(F.lit, ("timeout", "provider", "parse", "other"))), (F.col("event_id") % 4).cast("int")))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("tool"), F.col("user_id") % 7).alias("tool"), (F.col("event_type") != "error").alias("ok"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("error_kind"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cache entries."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("cache_key"), (1_700_000_000 + (F.col("doc_id") * 37) % 500).alias("updated_at"), F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 3 != 0, 1_700_000_000 + (F.col("doc_id") * 91) % 1000).alias("expires_at"))


@query("g1_tool_stats", f"WITH {SQL_EVENTS} SELECT tool, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure, arg_max(at_ms, seq) FILTER (ok) AS last_success_ms, arg_max(at_ms, seq) FILTER (NOT ok) AS last_failure_ms, (arg_max({{'k': error_kind}}, seq) FILTER (NOT ok)).k AS last_error_kind FROM e GROUP BY tool")
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tool_stats(calls(spark, sf_dir))


@query("g2_recent_calls", f"WITH {SQL_EVENTS} SELECT seq, tool, ok, error_kind FROM e ORDER BY seq DESC LIMIT 1000")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_calls(calls(spark, sf_dir), 0).select("seq", "tool", "ok", "error_kind")


@query("e15_recent_failures_of_tool", f"WITH {SQL_EVENTS} SELECT seq, error_kind FROM e WHERE tool = 'tool3' AND NOT ok ORDER BY seq DESC LIMIT 20")
def recent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent_calls(calls(spark, sf_dir), 20, "tool3", False).select("seq", "error_kind")


@query("s24_error_taxonomy", f"WITH {SQL_EVENTS}, d AS (SELECT * FROM (VALUES {', '.join(str((k, c, r)) for k, c, r in A.ERRORS)}) v(kind, code, retryable)) SELECT error_kind, code, coalesce(retryable, false) AS retryable, count(*) AS n FROM e LEFT JOIN d ON e.error_kind = d.kind WHERE NOT ok GROUP BY ALL")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = calls(spark, sf_dir).where("not ok").groupBy("error_kind").agg(F.count("*").alias("n"))
    joined = failed.join(A.error_dimension(spark), F.col("error_kind") == F.col("kind"), "left")
    return joined.select("error_kind", "code", F.coalesce("retryable", F.lit(False)).alias("retryable"), "n")


@query("k1_ttl_expire", f"WITH {SQL_CACHE} SELECT cache_key FROM c WHERE expires_at IS NULL OR expires_at > {NOW}")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expire(cache(spark, sf_dir), NOW).select("cache_key")


@query("k2_evict_entries", f"WITH {SQL_CACHE} SELECT cache_key, size_bytes FROM c QUALIFY row_number() OVER (ORDER BY updated_at DESC, cache_key DESC) <= 400")
def evict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evict(cache(spark, sf_dir), 400, 0).select("cache_key", "size_bytes")


@query("k3_evict_bytes", f"WITH {SQL_CACHE}, n AS (SELECT *, row_number() OVER w AS n, sum(size_bytes) OVER w AS b FROM c WINDOW w AS (ORDER BY updated_at DESC, cache_key DESC ROWS UNBOUNDED PRECEDING)) SELECT cache_key, size_bytes FROM n WHERE n <= 600 AND b <= 700000")
def evict_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evict(cache(spark, sf_dir), 600, 700_000).select("cache_key", "size_bytes")


@query("a21_cache_get", f"WITH {SQL_CACHE} SELECT cache_key, size_bytes FROM c WHERE cache_key = 'k00000003' AND (expires_at IS NULL OR expires_at > {NOW})")
def cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_entry(cache(spark, sf_dir), "k00000003", NOW).select("cache_key", "size_bytes")


@query("a33_cache_put", f"WITH {SQL_CACHE}, o AS (SELECT *, updated_at - 10 AS created_at FROM c WHERE size_bytes % 2 = 0), n AS (SELECT * FROM c WHERE size_bytes % 3 = 0) SELECT cache_key, coalesce(o.created_at, {NOW}) AS created_at, {NOW}::BIGINT AS updated_at FROM n LEFT JOIN o USING (cache_key) UNION ALL SELECT cache_key, created_at, updated_at FROM o WHERE cache_key NOT IN (SELECT cache_key FROM n)")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cache(spark, sf_dir)
    old = c.where("size_bytes % 2 = 0").withColumn("created_at", F.col("updated_at") - 10)
    put = put_entries(old, c.where("size_bytes % 3 = 0").withColumn("created_at", F.lit(None).cast("long")), NOW)
    return put.select("cache_key", F.col("created_at").cast("long").alias("created_at"), F.col("updated_at").cast("long").alias("updated_at"))


@query("k5_key_rotation", "SELECT (event_id + 2) % 5 AS key_no, count(*) AS n FROM events GROUP BY 1")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.round_robin(table(spark, sf_dir, "events").select(F.col("event_id").alias("request_no")), 5, 2).groupBy("key_no").agg(F.count("*").alias("n"))


SECRETS_OF = """CASE event_id % 4 WHEN 0 THEN '{"user":' || user_id || ',"api_key":"' || event_id || '","inner":{"list":[{"access_token":{"a":1},"ok":"é"}],"n":1.5}}' WHEN 1 THEN '[{"api_key":null},' || user_id || ',"api_key"]' WHEN 2 THEN 'no JSON ' || event_id ELSE NULL END"""


@query("s13_redact_json", """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"user":' || user_id || ',"api_key":"***","inner":{"list":[{"access_token":"***","ok":"é"}],"n":1.5}}' WHEN 1 THEN '[{"api_key":"***"},' || user_id || ',"api_key"]' WHEN 2 THEN 'no JSON ' || event_id END AS payload FROM events""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{SECRETS_OF} AS payload").select("id", A.redact_json(F.col("payload")).alias("payload"))


@query("s11_epoch_text", "SELECT doc_id, strftime(make_timestamp((1600000000 + doc_id * 98765)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM documents")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.functions.text import epoch_text

    return table(spark, sf_dir, "documents").select("doc_id", epoch_text(1_600_000_000 + F.col("doc_id") * 98_765).alias("at"))


@query("s10_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


@query(
    "a22_incremental_state",
    f"WITH {SQL_EVENTS}, r AS (SELECT tool, seq FROM e ORDER BY seq DESC LIMIT 1000), n AS (SELECT tool, count(*) AS n FROM r GROUP BY 1) SELECT tool, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure, arg_max(at_ms, seq) FILTER (ok) AS last_success_ms, arg_max(at_ms, seq) FILTER (NOT ok) AS last_failure_ms, coalesce(any_value(n.n), 0) AS in_recent FROM e LEFT JOIN n USING (tool) GROUP BY tool",
)
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three loads, each on the snapshot of the one before; the last comes twice."""
    path, events = f"{shared_root(spark)}/audit-state-{uuid.uuid4().hex}", calls(spark, sf_dir)
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    for share in (0.4, 0.7, 1.0, 1.0):
        audit_state.load(spark, path, events.where(F.col("seq") <= low + int((high - low) * share)))
    return audit_state.snapshot(spark, path)
