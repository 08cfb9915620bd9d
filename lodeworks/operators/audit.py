"""Tool-call audit: statistics by tool, recent calls, redaction, error dimension."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Error codes, which errors may be tried again, parts of secret keys.
ERRORS = [("parse", -32700, False), ("invalid_params", -32602, False), ("security_policy", -32602, False), ("not_found", -32004, False), ("timeout", -32002, True), ("provider", -32001, True), ("upstream", -32001, True), ("oauth", -32005, False), ("missing_config", -32003, False), ("config", -32003, False), ("io", -32006, False)]
SECRET_PARTS = ["authorization", "api_key", "apikey", "token", "secret", "cookie", "password"]
SECRET_PLAIN = ["apikey", "accesskey"]
RECENT = 1000


def tool_stats(events: DataFrame) -> DataFrame:
    """events (seq, tool, ok, at_ms, error_kind) -> one row per tool; "last" is by sequence, not by time.

    One shuffle on tool with partial aggregation: a tool may have any share of the events.
    """
    last = lambda cond: F.max_by(F.when(cond, F.col("at_ms")), F.when(cond, F.col("seq")))
    return events.groupBy("tool").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("failure"),
        last(F.col("ok")).alias("last_success_ms"),
        last(~F.col("ok")).alias("last_failure_ms"),
        F.max_by(F.struct("error_kind"), F.when(~F.col("ok"), F.col("seq")))["error_kind"].alias("last_error_kind"),
    )


def recent_calls(events: DataFrame, limit: int, tool: str | None = None, ok: bool | None = None) -> DataFrame:
    """The newest calls, of a tool or an outcome if asked; 0 means the default.  A top-k: each partition keeps limit rows."""
    limit = min(limit, RECENT) or RECENT
    rows = events if tool is None else events.where(F.col("tool") == tool)
    rows = rows if ok is None else rows.where(F.col("ok") == ok)
    return rows.orderBy(F.desc("seq")).limit(limit)


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "kind string, code int, retryable boolean")


# Statuses that speak against a key, and of a gateway's passing trouble; what messages of errors worth another try hold.
KEY_STATUSES, GATEWAY_STATUSES = [401, 403, 429, 432, 433], [502, 503, 504]
TRY_AGAIN = ["http 429", "too many requests", "rate limit", "http 500", "http 502", "http 503", "http 504", "request failed", "timeout"]
TRY_MODEL_AGAIN, TRY_DOWNLOAD_AGAIN = [*TRY_AGAIN, "token plan"], [*TRY_AGAIN, "timed out", "connect", "body read failed"]
ANSWER_REASONS = {"timeout": "timeout", "oauth": "auth_error", "parse": "parse_error"}
#: What to do about each kind of error.
HINTS = {
    "missing_config": "A setting has no value; give it one.", "config": "A setting cannot be read; compare it with the list of settings.", "invalid_params": "An argument is out of its range or of the wrong type.",
    "not_found": "Nothing goes by this name; search again for a current one.", "timeout": "No answer in time; wait, or allow more of it.", "upstream": "The service or the way to it failed; see its status, the key and the proxy.",
    "provider": "The service refused or failed; see its status, the key and the limits.", "security_policy": "Only public web addresses are fetched.", "oauth": "The sign-in has ended; sign in again.",
    "parse": "What came back could not be read.", "io": "A file could not be read or written; see its path and rights.",
}


def _holds(message: Column, phrases: list[str]) -> Column:
    low = F.lower(message)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))


def model_call_retryable(kind: Column, message: Column) -> Column:
    return F.coalesce(kind.isin("timeout", "upstream") | ((kind == "provider") & _holds(message, TRY_MODEL_AGAIN)), F.lit(False))


def download_retryable(kind: Column, message: Column) -> Column:
    return F.coalesce((kind == "timeout") | (kind.isin("upstream", "provider") & _holds(message, TRY_DOWNLOAD_AGAIN)), F.lit(False))


def status_class(status: Column) -> Column:
    """key: the next key may do better; transient: the same request may; else null."""
    return F.when(status.isin(*KEY_STATUSES), "key").when(status.isin(*GATEWAY_STATUSES), "transient")


def error_hint(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, h) for k, h in HINTS.items()))


def answer_failure(kind: Column) -> Column:
    """Why there is no answer, in the words of a fallback."""
    return F.coalesce(*(F.when(kind == k, r) for k, r in ANSWER_REASONS.items()), F.lit("provider_error"))


def is_secret(key: str) -> bool:
    low = key.lower()
    return any(p in low for p in SECRET_PARTS) or any(p in "".join(c for c in low if c.isalnum()) for p in SECRET_PLAIN)


def _redacted(value):
    if isinstance(value, dict):
        return {k: "***" if is_secret(k) else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


def redact_json(payload: Column) -> Column:
    """Secret keys' values replaced at any depth; text that is no JSON is returned as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return text if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return text

        return texts.map(one)

    return run(payload)


def round_robin(requests: DataFrame, n_keys: int, attempt: int = 0) -> DataFrame:
    """Which key serves a request (request_no) at an attempt."""
    return requests.withColumn("key_no", F.pmod(F.col("request_no") + attempt, F.lit(n_keys)))



def expire(entries: DataFrame, now: int) -> DataFrame:
    """Entries that have not expired."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def evict(entries: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """The newest entries within both caps (0: no cap): entry cap first, then the longest newest-first run within the byte cap.

    Ranks and running sums are global, so they are taken in two levels: within ranges of updated_at, which tasks
    hold apart, and over the ranges' totals, a row for each partition.
    """
    order = [F.desc("updated_at"), F.desc("cache_key")]
    ranged = entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order)
    numbered = ranged.withColumn("n", F.row_number().over(inside)).withColumn("b", F.sum("size_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = numbered.groupBy("part").agg(F.count("*").alias("pn"), F.sum("size_bytes").alias("pb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b0"))
    placed = numbered.join(F.broadcast(offsets), F.col("part") == F.col("p"))  # a row for each partition of the range exchange
    kept = placed
    if max_entries:
        kept = kept.where(F.col("n") + F.col("n0") <= max_entries)
    if max_bytes:
        kept = kept.where(F.col("b") + F.col("b0") <= max_bytes)
    return kept.select(*entries.columns)
