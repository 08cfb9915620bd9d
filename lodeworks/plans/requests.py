"""Registered queries of requests to providers, completed tables and figures, cache listings and audit snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import requests as Q
from lodeworks.operators import audit as A
from lodeworks.operators import vision_output as O
from lodeworks.plans.audit import SQL_EVENTS
from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql, over
from lodeworks.sources.tables import table, values

#: The benchmark's items as queries, with filters by rule.
SQL_ASKED = "q AS (SELECT item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'web' WHEN item_id % 3 = 0 THEN '' END AS platform, CASE WHEN item_id % 3 = 0 THEN (item_id % 30)::INT END AS days, CASE WHEN item_id % 4 = 0 THEN ['a.example', 'b.example'] ELSE []::VARCHAR[] END AS inc, CASE WHEN item_id % 5 = 0 THEN ['c.example'] ELSE []::VARCHAR[] END AS exc FROM benchmark)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: F.col("item_id") % m == 0
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("query"), F.when(n(2), "web").when(n(3), "").alias("platform"), F.when(n(3), F.col("item_id") % 30).cast("int").alias("days"),
        F.when(n(4), F.array(F.lit("a.example"), F.lit("b.example"))).otherwise(none).alias("inc"), F.when(n(5), F.array(F.lit("c.example"))).otherwise(none).alias("exc"),
    )


@query("p23_search_prompt", f"WITH {SQL_ASKED} SELECT item_id, query || CASE WHEN coalesce(platform, '') <> '' THEN chr(10) || chr(10) || 'Focus platform: ' || platform ELSE '' END || CASE WHEN days IS NOT NULL THEN chr(10) || chr(10) || 'Restrict evidence to sources published within the last ' || days || ' day(s).' ELSE '' END || CASE WHEN len(inc) > 0 THEN chr(10) || chr(10) || 'Prefer sources from: ' || array_to_string(inc, ', ') ELSE '' END || CASE WHEN len(exc) > 0 THEN chr(10) || chr(10) || 'Do not cite sources from: ' || array_to_string(exc, ', ') ELSE '' END || CASE WHEN item_id % 7 = 0 THEN chr(10) || chr(10) || 'Additional sources:' || chr(10) || '- u | t' || chr(10) || '- v' || chr(10) ELSE '' END AS prompt FROM q")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<url:string,title:string>>"
    extra = F.when(F.col("item_id") % 7 == 0, F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title")), F.struct(F.lit("v").alias("url"), F.lit(None).cast("string").alias("title"))).cast(kind)).otherwise(F.array().cast(kind))
    return asked(spark, sf_dir).select("item_id", Q.search_prompt(*(F.col(c) for c in ("query", "platform", "days", "inc", "exc")), extra).alias("prompt"))


@query("p23_source_bodies", f"WITH {SQL_ASKED} SELECT item_id, '{{\"query\":' || to_json(query) || ',\"max_results\":5,\"include_answer\":false' || coalesce(',\"days\":' || days || ',\"topic\":\"news\"', '') || CASE WHEN len(inc) > 0 THEN ',\"include_domains\":' || to_json(inc) ELSE '' END || CASE WHEN len(exc) > 0 THEN ',\"exclude_domains\":' || to_json(exc) ELSE '' END || '}}' AS body, '{{\"url\":\"u\",\"max_depth\":1,\"limit\":5}}' AS map_body FROM q")
def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("item_id", Q.source_search_body(F.col("query"), F.lit(5), F.col("days"), F.col("inc"), F.col("exc")).alias("body"), Q.map_body(F.lit("u"), F.lit(5)).alias("map_body"))


YEARS = "(0, NULL, NULL, NULL, 'relevance'), (1, 2020, 2020, true, 'citations'), (2, 2019, 2021, false, 'date'), (3, 2019, NULL, NULL, ' Date '), (4, NULL, 2021, true, 'CITATIONS'), (5, NULL, NULL, true, 'date')"


@query("p23_literature_filters", f"SELECT id, nullif(concat_ws(',', 'from_publication_date:' || a || '-01-01', 'to_publication_date:' || b || '-12-31', CASE WHEN oa THEN 'is_oa:true' END), '') AS works, CASE WHEN lower(trim(sort)) = 'citations' THEN 'cited_by_count:desc' WHEN lower(trim(sort)) = 'date' AND coalesce(a, b) IS NOT NULL THEN 'publication_date:desc' END AS works_order, CASE WHEN a = b THEN a::VARCHAR WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a::VARCHAR, '') || '-' || coalesce(b::VARCHAR, '') END AS years, CASE lower(trim(sort)) WHEN 'citations' THEN 'citationCount:desc' WHEN 'date' THEN 'publicationDate:desc' END AS papers_order FROM {by_page_sql(YEARS, "id, a, b, oa, sort", "")} v")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, oa, sort = (F.col(c) for c in ("a", "b", "oa", "sort"))
    return by_page(spark, sf_dir, YEARS, "id, a, b, oa, sort", "").select("id", Q.works_filter(a, b, oa).alias("works"), Q.works_order(sort, a, b).alias("works_order"), Q.year_filter(a, b).alias("years"), Q.papers_order(sort).alias("papers_order"))


@query("p24_payloads", "SELECT item_id, '{\"model\":\"m\",\"messages\":[{\"role\":\"system\",\"content\":' || to_json(CASE WHEN item_id % 2 = 0 THEN 'be brief' ELSE 'Search the web, answer briefly, and name the pages that each statement rests on; say it where they are few or doubtful.' END) || '},{\"role\":\"user\",\"content\":' || to_json(text) || '}],\"stream\":false' || CASE WHEN item_id % 3 = 0 THEN ',\"tools\":[{\"type\":\"web_search\"}]' ELSE '' END || '}' AS chat, '{\"model\":\"m\",\"input\":[' || CASE WHEN item_id % 2 = 0 THEN '{\"role\":\"system\",\"content\":\"be brief\"},' ELSE '' END || '{\"role\":\"user\",\"content\":' || to_json(text) || '}],\"tools\":[' || concat_ws(',', CASE WHEN item_id % 3 = 0 THEN '{\"type\":\"web_search\"}' END, CASE WHEN item_id % 5 = 0 THEN '{\"type\":\"x_search\"}' END) || '],\"stream\":false}' AS answer FROM benchmark")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: F.col("item_id") % m == 0
    system = F.when(n(2), "be brief").otherwise(" ")
    return table(spark, sf_dir, "benchmark").select("item_id", Q.chat_payload(F.lit("m"), system, F.col("text"), n(3)).alias("chat"), Q.answer_payload(F.lit("m"), system, F.col("text"), n(3), n(5)).alias("answer"))


REPOS = "SELECT 'o' || CAST(c_custkey % 5 AS STRING) AS o, 'r' || CAST(c_nationkey AS STRING) AS r, CAST(c_custkey AS STRING) AS n, CAST(c_custkey % 300 AS INT) AS m FROM customer"


@query("t19_addresses", f"SELECT n, 'https://api.github.com/repos/' || o || '/' || r || '/pulls/' || n || '/reviews?per_page=' || k AS reviews, 'https://api.stackexchange.com/2.3/questions/' || n || '?site=' || r || '&filter=f' AS question, 'https://api.stackexchange.com/2.3/questions/' || n || '/answers?site=' || r || '&filter=f&order=desc&sort=votes&pagesize=' || k AS answers FROM (SELECT *, least(greatest(m + 1, 1), 100) AS k FROM ({REPOS}))")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r, n, m = (F.col(c) for c in "ornm")
    return over(spark, sf_dir, REPOS, "customer").select("n", F.get(Q.comment_addresses(o, r, n, m), F.lit(2)).alias("reviews"), Q.question_address(n, r, "f").alias("question"), Q.answers_address(n, r, "f", m).alias("answers"))


COMPLETIONS = """(0, '{"table_completions":[{"page":3,"label":"Table 1","status":"Complete","headers":["a","b"],"rows":[["1","2"],["3"]],"confidence":0.9},{"status":"not-visible","markdown":"| x |","notes":"n"},{"status":"odd"}],"figure_completions":[{"label":"F","status":"READY"},{"status":"broken"},{},{"status":"missing"},{"status":"fifth"}]}'), (1, '{}'), (2, 'no json')"""
SQL_COMPLETED = f"SELECT * FROM {by_page_sql("(0, 'table', 0, 3, 'Table 1', 'reconstructed', 'ok', '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || '| 3 |  |'), (0, 'table', 1, 0, NULL, 'not_visible', 'missed', '| x |'), (0, 'table', 2, 0, NULL, 'uncertain', 'uncertain', NULL), (0, 'figure', 0, 0, 'F', 'crop_ready', 'ok', NULL), (0, 'figure', 1, 0, NULL, 'fragmented', 'uncertain', NULL), (0, 'figure', 2, 0, NULL, 'uncertain', 'uncertain', NULL), (0, 'figure', 3, 0, NULL, 'not_visible', 'missed', NULL)", 'id, kind, n, page, label, status, repair, markdown', turns=3)} v"


@query("p22_completions", SQL_COMPLETED)
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With L8: the repair that each completion stands for."""
    return O.completions(by_page(spark, sf_dir, COMPLETIONS, "id, raw"), F.lit(0)).select("id", "kind", "n", "page", "label", "status", "repair", "markdown")


@query("a22_audit_snapshot", f"WITH {SQL_EVENTS}, t AS (SELECT tool, count(*) AS total, count(*) FILTER (NOT ok) AS failure FROM e GROUP BY 1), r AS (SELECT tool, seq FROM e QUALIFY row_number() OVER (ORDER BY seq DESC) <= 100) SELECT tool, any_value(total) AS total, any_value(failure) AS failure, count(seq) AS in_recent FROM t LEFT JOIN r USING (tool) GROUP BY 1")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's state as one table: statistics by tool with each tool's share of the newest 100 calls."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("tool"), F.col("user_id") % 7).alias("tool"), (F.col("event_type") != "error").alias("ok"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.lit(None).cast("string").alias("error_kind"))
    recent = e.orderBy(F.desc("seq")).limit(100).groupBy("tool").agg(F.count("*").alias("in_recent"))
    return A.tool_stats(e).join(recent, "tool", "left").select("tool", "total", "failure", F.coalesce("in_recent", F.lit(0)).cast("long").alias("in_recent"))


@query("t22_cache_list_remove", "SELECT doc_id::VARCHAR AS cache_key, n_chars AS size_bytes FROM documents WHERE doc_id % 3 <> 0 AND starts_with(doc_id::VARCHAR, '1')")
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are left after some were removed, with a prefix."""
    d = table(spark, sf_dir, "documents")
    entries = d.select(F.col("doc_id").cast("string").alias("cache_key"), F.col("n_chars").alias("size_bytes"))
    gone = d.where(F.col("doc_id") % 3 == 0).select(F.col("doc_id").cast("string").alias("cache_key"))
    return entries.join(gone, "cache_key", "left_anti").where(F.startswith("cache_key", F.lit("1")))


FAILURES = "(0, 'timeout', NULL, 504), (1, 'upstream', 'Connection reset', 502), (2, 'provider', 'HTTP 429 Too Many', 429), (3, 'provider', 'token plan used up', 432), (4, 'provider', 'bad request', 400), (5, 'oauth', 'timeout', 401), (6, 'parse', NULL, 200), (7, 'provider', 'Body read failed', 503), (8, 'upstream', 'odd', 500)"


@query(
    "e11_failure_classes",
    f"""SELECT id, coalesce(kind IN ('timeout', 'upstream') OR (kind = 'provider' AND regexp_matches(lower(message), 'http 429|too many requests|rate limit|token plan|http 50[0234]|request failed|timeout')), false) AS model_again, coalesce(kind = 'timeout' OR (kind IN ('upstream', 'provider') AND regexp_matches(lower(message), 'http 429|too many requests|rate limit|http 50[0234]|timed out|timeout|connect|body read failed|request failed')), false) AS download_again,
CASE WHEN status IN (401, 403, 429, 432, 433) THEN 'key' WHEN status IN (502, 503, 504) THEN 'transient' END AS status_class, CASE kind WHEN 'timeout' THEN 'timeout' WHEN 'oauth' THEN 'auth_error' WHEN 'parse' THEN 'parse_error' ELSE 'provider_error' END AS reason, CASE kind {' '.join(f"WHEN '{k}' THEN '{h}'" for k, h in A.HINTS.items())} END AS hint FROM {by_page_sql(FAILURES, "id, kind, message, status", "")} v""",
)
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, message = F.col("kind"), F.col("message")
    return by_page(spark, sf_dir, FAILURES, "id, kind, message, status", "").select("id", A.model_call_retryable(kind, message).alias("model_again"), A.download_retryable(kind, message).alias("download_again"), A.status_class(F.col("status")).alias("status_class"), A.answer_failure(kind).alias("reason"), A.error_hint(kind).alias("hint"))
