"""Registered streaming queries, drained over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.audit import SQL_EVENTS
from lodeworks.plans.registry import query
from lodeworks.sources.tables import table
from lodeworks.streaming import audit_stream as S
from lodeworks.streaming import responses as R


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_stream(spark, f"{sf_dir}/events.parque[t]")


@query("st_running_tool_stats", f"WITH {SQL_EVENTS} SELECT tool, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure, arg_max(at_ms, seq) FILTER (ok) AS last_success_ms FROM e GROUP BY tool")
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    calls = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("tool"), F.col("user_id") % 7).alias("tool"), (F.col("event_type") != "error").alias("ok"), F.unix_millis("ts").alias("at_ms"), F.lit(None).cast("string").alias("error_kind"))
    return S.drain(S.running_stats(calls), ["tool"]).select("tool", "total", "success", "failure", "last_success_ms")


@query("st_error_windows", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.error_windows(_events(spark, sf_dir)), ["window_start"])


def _event(value, blank: str = "\n\n", name: str | None = None):
    """A server-sent event as bytes of text; value is a column of JSON text."""
    return F.concat(F.lit(f"event: {name}\n" if name else ""), F.lit("data: "), value, F.lit(blank))


def _streamed_turns(turns: DataFrame) -> DataFrame:
    """resp_id, body: turns as providers stream them; by turn modulo 5 in deltas, as chat with citations, failed, completed, never ended."""
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    first, second = F.left(text, half), F.substring(text, half + 1, F.length(text))
    delta = lambda t: _event(F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), t.alias("delta"))), name="response.output_text.delta")
    chat = lambda t: _event(F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), "\r\n\r\n")
    cited = F.array(F.concat(F.lit("https://a.example/"), "conv_id"), F.lit("https://b.example/"), F.lit("https://b.example/"))
    failed = F.to_json(F.struct(F.lit("response.failed").alias("type"), F.struct(F.struct(F.col("role").alias("message")).alias("error")).alias("response")))
    whole = F.to_json(F.struct(F.lit("response.completed").alias("type"), F.struct(text.alias("output_text"), cited.alias("citations")).alias("response")))
    deltas = F.concat(delta(first), delta(second))
    bodies = [
        F.concat(deltas, _event(F.lit('{"type":"response.completed"}'))),
        F.concat(chat(first), _event(F.to_json(F.struct(cited.alias("citations"))), "\r\r"), chat(second), F.lit("event: done\n\n")),
        F.concat(deltas, _event(failed)),
        F.concat(delta(first), F.lit(": a comment\n\n"), _event(whole)),
        deltas,
    ]
    body = F.element_at(F.array(*bodies), (F.col("turn") % 5 + 1).cast("int"))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("resp_id"), F.encode(body, "UTF-8").alias("body"))


STEPS = 3


@query(
    "st_response_streams",
    """SELECT conv_id || '-' || turn AS resp_id, ['completed', 'done', 'failed', 'completed', 'closed'][turn % 5 + 1] AS ended, coalesce(text, '') AS content,
  CASE WHEN turn % 5 IN (1, 3) THEN 'https://a.example/' || conv_id || ' https://b.example/' ELSE '' END AS sources,
  CASE WHEN turn % 5 = 2 THEN 'stream stream ended with response.failed: ' || role END AS error FROM conversations""",
)
def response_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn streamed in chunks of 97 bytes that arrive in any order in three steps, the stream started anew for each; those that never end are closed by their timer."""
    streamed = _streamed_turns(table(spark, sf_dir, "conversations"))
    pieces = streamed.select("resp_id", "body", F.posexplode(F.sequence(F.lit(1), F.octet_length("body"), F.lit(97))).alias("seq", "place"))
    pieces = pieces.select("resp_id", F.col("seq").cast("long").alias("seq"), F.expr("substring(body, place, 97)").alias("chunk"), F.lit(False).alias("closed"), F.pmod(F.xxhash64("resp_id", "seq"), F.lit(STEPS)).alias("step"))
    at = lambda minutes: F.lit("2024-01-01").cast("timestamp") + F.expr(f"make_interval(0, 0, 0, 0, 0, {minutes})")
    clock = spark.sql("SELECT 'clock' AS resp_id, 0L AS seq, binary('data: [DONE]') AS chunk, true AS closed")
    steps = [pieces.where(F.col("step") == k).drop("step").withColumn("at", at(k)) for k in range(STEPS)] + [clock.withColumn("at", at(60 * k)) for k in (1, 2)]
    rows = R.drain_in_steps(spark, steps)
    return rows.where("resp_id <> 'clock'").select("resp_id", "ended", "content", F.array_join("sources", " ").alias("sources"), "error")
