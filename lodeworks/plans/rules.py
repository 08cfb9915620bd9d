"""Registered queries of small rules and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import rules as R
from lodeworks.operators import entities as E
from lodeworks.operators import sources_ops as S
from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_group, by_group_sql, by_page, by_page_sql, over
from lodeworks.plans.sources import SQL_HOST
from lodeworks.sources.tables import table, values


def _rows(items: list[str]) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))


POLICY = ["http://9.9.9.9/x", "https://10.20.30.40", "http://127.8.0.1:80/", "http://172.16.0.9/", "http://172.15.0.9/", "http://192.168.77.5", "http://169.254.9.9", "http://239.1.2.3", "http://0.1.2.3/", "http://localhost/a", "http://lode.localhost.", "http://localhost./", "https://lode.example", "ftp://lode.example", "http://[::1]/", "http://[2001:db8::7]/", "http://[fe90::7]/", "http://[fd12::7]/", "http://[ff02::1]/", "http://u@100.70.0.7/", "http://10.0.0.7./", "HTTPS://lode.example"]


@query(
    "e9_public_url",
    f"""WITH v AS (SELECT id, regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)), '\\.+$', '') AS h FROM {by_page_sql(_rows(POLICY), "id, url", "url")} v), o AS (SELECT *, try_cast(split_part(h, '.', 1) AS INT) AS a, try_cast(split_part(h, '.', 2) AS INT) AS b FROM v)
SELECT id, CASE WHEN h = '' THEN false WHEN regexp_matches(h, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN NOT (a IN (10, 127, 0) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) WHEN h LIKE '[%' THEN NOT regexp_matches(h, '^\\[(::1?|f[cd].*|fe[89ab].*|ff.*)\\]$') ELSE h <> 'localhost' AND NOT suffix(h, '.localhost') END AS public FROM o""",
)
def public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(POLICY), "id, url", "url").select("id", R.is_public_url(F.col("url")).alias("public"))


#: Hosts of the pages' numbers: within, at and beside the entries.
PROXY = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a' || CAST(page_id AS STRING) || '.example.com' WHEN 1 THEN 'example.com' WHEN 2 THEN 'bad' || CAST(page_id AS STRING) || 'example.com' WHEN 3 THEN 'intra' WHEN 4 THEN 'x.corp.net' ELSE 'p' || CAST(page_id AS STRING) || '.example.org' END AS host FROM pages"


@query("e10_no_proxy", f"SELECT page_id, host, host = 'example.com' OR suffix(host, '.example.com') OR host = 'corp.net' OR suffix(host, '.corp.net') OR host = 'intra' AS direct FROM ({PROXY})")
def no_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(F.lit("example.com"), F.lit("*.corp.net"), F.lit(" INTRA "), F.lit(""))
    return over(spark, sf_dir, PROXY, "pages").select("page_id", "host", R.bypasses_proxy(F.col("host"), entries).alias("direct"))


HOSTS = ["stackoverflow.com", "meta.stackoverflow.com", "dsp.stackexchange.com", "meta.stackexchange.com", "mathoverflow.net", "example.com", "en.wikipedia.org", "zh-yue.m.wikipedia.org"]


@query("s17_sites", f"SELECT * FROM {by_page_sql("(0, 'stackoverflow', NULL), (1, 'meta.stackoverflow', NULL), (2, 'dsp', NULL), (3, 'meta.stackexchange', NULL), (4, 'mathoverflow.net', NULL), (5, NULL, NULL), (6, NULL, 'en'), (7, NULL, 'zh-yue')", 'id, site, lang')} v")
def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(HOSTS), "id, host").select("id", R.question_site(F.col("host")).alias("site"), R.wiki_language(F.col("host")).alias("lang"))


REPOSITORIES = ["https://github.com/a/b.git", "https://www.github.com/a/b/tree/main", "https://huggingface.co/datasets/o/n", "https://huggingface.co/spaces/o/n", "https://huggingface.co/o/n", "https://example.com/a/b", "https://github.com/a"]


@query("s26_repository", f"SELECT * FROM {by_page_sql("(0, 'github', 'repository', 'a/b'), (1, 'github', 'repository', 'a/b'), (2, 'huggingface', 'dataset', 'o/n'), (3, 'huggingface', 'space', 'o/n'), (4, 'huggingface', 'model', 'o/n'), (5, NULL, NULL, NULL), (6, NULL, NULL, NULL)", 'id, provider, kind, name')} v")
def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(REPOSITORIES), "id, url").select("id", R.repository(F.col("url")).alias("r")).select("id", "r.*")


BASES = ["https://x.example", "https://x.example/v1/", "https://x.example/v1/chat/completions", " https://x.example/api/v1/responses "]


@query("s15_base_url", f"SELECT id, CASE WHEN suffix(b, '/v1') THEN b ELSE b || '/v1' END AS base FROM (SELECT id, regexp_replace(rtrim(trim(u), '/'), '/(chat/completions|responses)$', '') AS b FROM {by_page_sql(_rows(BASES), "id, u", "u")} v)")
def base_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(BASES), "id, u", "u").select("id", R.versioned_base(F.col("u")).alias("base"))


ATTEMPTS = "SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'llm' WHEN 2 THEN 'openalex' WHEN 3 THEN 'semantic' WHEN 4 THEN 'arxiv' ELSE 'none' END AS service, CAST(user_id % 11 - 1 AS INT) AS attempt FROM events"


@query(
    "s23_backoff",
    f"""SELECT service, attempt, CASE service WHEN 'pdf' THEN CASE WHEN attempt <= 1 THEN 600 WHEN attempt = 2 THEN 1200 ELSE 2400 END WHEN 'llm' THEN 600 * 2 ** least(greatest(attempt - 1, 0), 4) WHEN 'openalex' THEN CASE WHEN attempt <= 0 THEN 1000 ELSE 3000 END WHEN 'semantic' THEN 2500 + 2500 * greatest(attempt, 0) WHEN 'arxiv' THEN 3000 * (greatest(attempt, 0) + 1) END::INT AS ms FROM ({ATTEMPTS})""",
)
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, ATTEMPTS, "events").select("service", "attempt", R.backoff_ms(F.col("service"), F.col("attempt")).alias("ms"))


IDS = "(0, '10.1/a', NULL, 's', NULL, 't'), (1, NULL, '2301.4', NULL, 'W1', 't'), (2, NULL, NULL, NULL, NULL, 'only title'), (3, NULL, NULL, 's', 'W2', NULL)"


@query("s9_identifier_preference", f"SELECT id, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN semantic IS NOT NULL THEN 'semantic' WHEN openalex IS NOT NULL THEN 'openalex' ELSE 'query' END AS kind, coalesce(doi, arxiv, semantic, openalex, title) AS value, concat_ws(' ', 'semantic:' || semantic, 'openalex:' || openalex, 'doi:' || doi, 'arxiv:' || arxiv) AS for_citations FROM {by_page_sql(IDS, "id, doi, arxiv, semantic, openalex, title", "")} v")
def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("doi", "arxiv", "semantic", "openalex")]
    return by_page(spark, sf_dir, IDS, "id, doi, arxiv, semantic, openalex, title", "").select("id", R.best_identifier(*c, F.col("title")).alias("b"), R.citation_identifiers(*c).alias("for_citations")).select("id", "b.*", "for_citations")


PUBLISHERS = ["https://ieeexplore.ieee.org/document/123", "https://ieeexplore.ieee.org/abstract/document/456/", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber=789", "https://dl.acm.org/doi/abs/10.1145/1.2", "https://example.com"]


@query("s19_publisher_pdf", f"SELECT * FROM {by_page_sql("(0, 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber=123'), (1, 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber=456'), (2, 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber=789'), (3, 'https://dl.acm.org/doi/pdf/10.1145/1.2'), (4, NULL)", 'id, pdf')} v")
def publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(PUBLISHERS), "id, url").select("id", R.publisher_pdf(F.col("url")).alias("pdf"))


NUMBERS = "(0, '1,234'), (1, ' 7 '), (2, 'x'), (3, NULL), (4, '')"


@query("s27_tolerant_numbers", f"SELECT id, coalesce(try_cast(replace(trim(x), ',', '') AS BIGINT), 0) AS n FROM {by_page_sql(NUMBERS, 'id, x')} v")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, NUMBERS, "id, x").select("id", R.tolerant_number(F.col("x")).alias("n"))


ANSWERED = "(0, 'text', 2, 3), (1, ' ', 2, 2), (2, 'text', 0, 4), (3, 'text', 0, 0), (4, NULL, 0, 0)"


@query("e8_unverifiable", f"SELECT id, CASE WHEN trim(coalesce(a, '')) = '' THEN 'content_empty' WHEN n = 0 AND b > 0 THEN 'sources_empty_filtered' WHEN n = 0 THEN 'sources_empty' END AS reason FROM {by_page_sql(ANSWERED, "id, a, n, b", "")} v")
def unverifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, ANSWERED, "id, a, n, b", "").select("id", S.unverifiable_reason(F.col("a"), F.col("n"), F.col("b")).alias("reason"))


MATERIALS = "(1, 0, 'https://A.example/x', 'code'), (1, 1, 'https://a.example/X', 'demo'), (1, 2, 'https://b.example', 'data'), (2, 0, 'https://a.example/x', 'code')"


@query("c3_merge_materials", f"SELECT paper_id, pos, url, kind FROM {by_group_sql(MATERIALS, "paper_id, pos, url, kind")} v QUALIFY row_number() OVER (PARTITION BY paper_id, lower(url) ORDER BY pos) = 1")
def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_materials(by_group(spark, sf_dir, MATERIALS, "paper_id, pos, url, kind"), "paper_id")


CANDIDATES = "(1, 0, 50, NULL, 2020, 5), (1, 1, 90, '10.1/a', NULL, 3), (1, 2, 90, '10.1/b', 2019, 9), (2, 0, 1, NULL, NULL, NULL)"


@query("c8_canonical_merge", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, pos) AS k FROM {by_group_sql(CANDIDATES, "g, pos, score, doi, year, citations")} v) SELECT g, arg_min(doi, k) FILTER (doi IS NOT NULL) AS doi, arg_min(year, k) FILTER (year IS NOT NULL) AS year, max(citations) AS citations, count(*) AS n_merged FROM r GROUP BY 1")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.absorb(by_group(spark, sf_dir, CANDIDATES, "g, pos, score, doi, year, citations"), "g", [F.desc("score"), F.col("pos")], ["doi", "year"], ["citations"])


LOCATIONS = "(1, 0, 'u1', 'open'), (1, 1, 'u2', 'institutional'), (1, 2, 'u1', 'institutional'), (1, 3, 'u3', 'open'), (1, 4, 'u3', 'open')"


@query("c9_prefer_institutional", f"WITH r AS (SELECT *, min(pos) OVER (PARTITION BY g, url) AS place, row_number() OVER (PARTITION BY g, url ORDER BY CASE WHEN source = 'institutional' THEN 0 ELSE 1 END, pos) AS k FROM {by_group_sql(LOCATIONS, "g, pos, url, source")} v) SELECT g, place AS pos, url, source FROM r WHERE k = 1")
def prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replace_preferred(by_group(spark, sf_dir, LOCATIONS, "g, pos, url, source"), "url", "g", F.col("source") == "institutional")


@query("g8_first_errors", "SELECT 'user' || (user_id % 9) AS source, arg_min(event_type || event_id, event_id) AS error, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.first_errors(e.select(F.concat(F.lit("user"), F.col("user_id") % 9).alias("source"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.concat("event_type", "event_id")).alias("error")))


@query("t1_first_provider", f"WITH r AS (SELECT page_id % 20 AS q, CASE WHEN page_id % 4 = 0 AND page_id % 20 < 8 THEN 0 ELSE 1 END AS prio, page_id, {SQL_HOST('url')} AS host FROM pages) SELECT q, prio, page_id, host FROM r QUALIFY prio = min(prio) OVER (PARTITION BY q)")
def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.functions.urls import host_for_match

    p = table(spark, sf_dir, "pages")
    rows = p.select((F.col("page_id") % 20).alias("q"), F.when((F.col("page_id") % 4 == 0) & (F.col("page_id") % 20 < 8), 0).otherwise(1).alias("prio"), "page_id", host_for_match(F.col("url")).alias("host"))
    return E.first_provider(rows, "q", "prio")


@query("n9_enrich_sources", "SELECT (page_id % 10)::VARCHAR AS session_id, page_id // 10 AS pos, url, CASE WHEN page_id // 10 < 3 THEN CASE WHEN page_id % 3 = 0 THEN '[not fetched: timeout]' WHEN page_id % 3 = 1 THEN left(html, 50) END END AS content FROM pages")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    sources = p.select((F.col("page_id") % 10).cast("string").alias("session_id"), F.floor(F.col("page_id") / 10).alias("pos"), "url")
    contents = p.select("url", F.when(F.col("page_id") % 3 == 1, F.left("html", F.lit(50))).alias("content"), F.when(F.col("page_id") % 3 == 0, "timeout").alias("error"))
    return E.enrich(sources, contents, 3)


@query("j7_fallback_sections", "SELECT conv_id AS doc_id, 'user' AS section_id, min(turn) AS section_start, max(turn) AS section_end FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT conv_id, 'sec_000_paper', 0, sum(octet_length(encode(text)))::BIGINT FROM conversations GROUP BY 1 HAVING conv_id % 3 = 0 OR count(*) FILTER (role = 'user') = 0")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    sections = c.where("role = 'user' and conv_id % 3 <> 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit("user").alias("section_id"), F.min("turn").alias("section_start"), F.max("turn").alias("section_end"))
    return E.fallback_sections(docs, sections)


@query("k4_session_recency")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("cache_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "put").otherwise("get").alias("op"), (F.col("event_id") % 40).cast("string").alias("key"))
    return E.recently_used(log, 16)
