"""Registered queries of cited sources: hosts, filters, routing, merging, pages, weights, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions import urls as U
from lodeworks.operators import sources_ops as S
from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql
from lodeworks.sources.tables import table, values

SQL_HOST = lambda c: f"nullif(regexp_replace(lower(CASE WHEN contains(replace(trim({c}), ' ', '%20'), '://') THEN regexp_extract(replace(trim({c}), ' ', '%20'), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE regexp_extract(replace(trim({c}), ' ', '%20'), '^([^/?#:]*)(?:[/?#]|$)', 1) END), '^(www\\.)+|\\.+$', '', 'g'), '')"
URLS = ["https://www.www.Example.com/a", "http://user:pw@shop.example.com:8080/x?y#z", "https://example.org./p q", "example.net/path", "not a url", "", "https://github.com/a/b/issues/12", "https://github.com/a/b/pull/7", "https://github.com/a/b", "https://github.com/a/b/pull/x", "https://stackoverflow.com/questions/11/title", "https://meta.superuser.com/questions/5", "https://dsp.stackexchange.com/questions/9/x", "https://arxiv.org/abs/2301.04567", "https://arxiv.org/list", "https://en.wikipedia.org/wiki/Golay_code", "https://en.wikipedia.org/wiki/Talk%3AGolay", "https://de.wikipedia.org/wiki/File:X.png", "https://en.wikipedia.org/wiki/C%2B%2B", "https://docs.example.com/docs/x"]
URL_ROWS = ", ".join(f"({i}, '{u}')" for i, u in enumerate(URLS))
INCLUDE, EXCLUDE = ["example.com", "www.example.org"], ["shop.example.com"]


def sources(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Pages as two providers' lists of a session; every fifth page is in both."""
    p = table(spark, sf_dir, "pages").where((F.col("page_id") % 2 == side) | (F.col("page_id") % 5 == 0))
    return p.select(F.floor(F.col("page_id") / 10).cast("string").alias("session_id"), F.col("page_id").alias("pos"), "url", F.lit("ab"[side]).alias("provider"), F.col("html").alias("content"))


SQL_SIDE = lambda side: f"SELECT (page_id // 10)::VARCHAR AS session_id, page_id AS pos, url, '{'ab'[side]}' AS provider, html AS content, {side} AS side FROM pages WHERE page_id % 2 = {side} OR page_id % 5 = 0"
SQL_MERGED = f"m AS (SELECT session_id, url, provider, content, row_number() OVER (PARTITION BY session_id ORDER BY side, pos) - 1 AS pos FROM (SELECT * FROM ({SQL_SIDE(0)} UNION ALL {SQL_SIDE(1)}) WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY session_id, url ORDER BY side, pos) = 1))"


@query("s1_host_extract", f"SELECT page_id, {SQL_HOST('url')} AS host FROM pages UNION ALL SELECT -1 - id, {SQL_HOST('url')} FROM (VALUES {URL_ROWS}) v(id, url)")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(values(spark, URL_ROWS, "id, url").select((-1 - F.col("id")).cast("long").alias("page_id"), "url"))
    return rows.select("page_id", U.host_for_match(F.col("url")).alias("host"))


@query(
    "e1_domain_filter",
    f"WITH h AS (SELECT id, {SQL_HOST('url')} AS host FROM {by_page_sql(URL_ROWS, "id, url", "url")} v) SELECT id, CASE WHEN host IS NULL THEN false ELSE (host = 'example.com' OR suffix(host, '.example.com') OR host = 'example.org' OR suffix(host, '.example.org')) AND NOT (host = 'shop.example.com' OR suffix(host, '.shop.example.com')) END AS both, host IS NULL OR NOT (host = 'shop.example.com' OR suffix(host, '.shop.example.com')) AS excluded_only FROM h",
)
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc, exc, none = F.array(*map(F.lit, INCLUDE)), F.array(*map(F.lit, EXCLUDE)), F.array().cast("array<string>")
    host = U.host_for_match(F.col("url"))
    return by_page(spark, sf_dir, URL_ROWS, "id, url", "url").select("id", U.allowed(host, inc, exc).alias("both"), U.allowed(host, none, exc).alias("excluded_only"))


@query("e2_domain_include", f"WITH h AS (SELECT page_id, {SQL_HOST('url')} AS host FROM pages), top AS (SELECT host FROM h GROUP BY 1 ORDER BY count(*) DESC, host LIMIT 3) SELECT page_id FROM h WHERE EXISTS (SELECT 1 FROM top WHERE h.host = top.host OR suffix(h.host, '.' || top.host))")
def domain_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below the three most frequent hosts: hosts' suffixes meet the asked domains in an equi-join."""
    h = table(spark, sf_dir, "pages").select("page_id", U.host_for_match(F.col("url")).alias("host"))
    top = h.groupBy("host").count().orderBy(F.desc("count"), "host").limit(3).select(F.col("host").alias("domain"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return h.where("host is not null").select("page_id", F.explode(suffixes).alias("suffix")).join(top, F.col("suffix") == F.col("domain"), "left_semi").select("page_id").distinct()


@query(
    "n1_source_type",
    f"""WITH v AS (SELECT id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM {by_page_sql(URL_ROWS, "id, url", "url")} v),
w AS (SELECT *, url_decode(coalesce(s[2], '')) AS title FROM v)
SELECT id, CASE WHEN host = 'github.com' AND len(s) = 4 AND s[3] = 'issues' AND regexp_matches(s[4], '^[0-9]{{1,19}}$') THEN 'github_issue' WHEN host = 'github.com' AND len(s) = 4 AND s[3] = 'pull' AND regexp_matches(s[4], '^[0-9]{{1,19}}$') THEN 'github_pr' WHEN host = 'github.com' AND len(s) = 2 THEN 'github_repo'
WHEN (regexp_matches(host, '^(meta\\.)?(stackoverflow\\.com|serverfault\\.com|superuser\\.com|askubuntu\\.com|mathoverflow\\.net)$') OR suffix(host, '.stackexchange.com')) AND s[1] = 'questions' AND regexp_matches(coalesce(s[2], ''), '^[0-9]{{1,19}}$') THEN 'stack_exchange'
WHEN host = 'arxiv.org' AND s[1] IN ('abs', 'pdf') AND s[2] IS NOT NULL THEN 'arxiv'
WHEN suffix(host, '.wikipedia.org') AND s[1] = 'wiki' AND s[2] IS NOT NULL AND NOT regexp_matches(lower(title), '^(special|talk|category|help|user|wikipedia|file|template|portal|draft):') THEN 'wikipedia' ELSE 'generic' END AS source_type FROM w""",
)
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, URL_ROWS, "id, url", "url").select("id", U.source_type(F.col("url")).alias("source_type"))


@query("c1_merge_sources", f"WITH {SQL_MERGED} SELECT session_id, url, provider, content, pos FROM m")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_sources(sources(spark, sf_dir, 0), sources(spark, sf_dir, 1))


@query("f4_page_sources", f"WITH {SQL_MERGED}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM m) SELECT session_id, url, provider, content, pos, total, CASE WHEN least(7, total) < total THEN least(7, total) END AS next_offset FROM n WHERE pos >= 3 AND pos < 7")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(S.merge_sources(sources(spark, sf_dir, 0), sources(spark, sf_dir, 1)), "session_id", 3, 4)


@query("f5_source_weight", "SELECT page_id, (64 + length(url) + length(html))::BIGINT AS weight FROM pages")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.source_weight(F.col("url"), F.col("html")).cast("long").alias("weight"))


ENTITIES = ["a &lt; b &amp;lt; c", "Poincar&#233; &#x1F600;&#X41;", "&nbsp; & &; &apos;x&quot;", "&#1114112; &#55296; &#x110000; &#99999999999;", "AT&T &gt", "none", ""]
ENTITY_ROWS = ", ".join("({}, '{}')".format(-1 - i, e) for i, e in enumerate(ENTITIES))
SQL_ENTITY = "&(lt|gt|amp|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);"
SQL_CODE = "CASE WHEN e LIKE '#x%' OR e LIKE '#X%' THEN try_cast('0x' || e[3:] AS BIGINT) WHEN e LIKE '#%' THEN try_cast(e[2:] AS BIGINT) END"


@query(
    "h10_entity_decode",
    f"""WITH s AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM (VALUES {ENTITY_ROWS}) v(page_id, html)), p AS (SELECT page_id, string_split_regex(html, '{SQL_ENTITY}') AS parts, list_append(regexp_extract_all(html, '{SQL_ENTITY}', 1), NULL) AS ents FROM s),
u AS (SELECT page_id, unnest(parts) AS part, unnest(ents) AS e, generate_subscripts(parts, 1) AS n FROM p), d AS (SELECT page_id, n, part, e, {SQL_CODE} AS code FROM u)
SELECT page_id, string_agg(part || CASE WHEN e IS NULL THEN '' WHEN e = 'lt' THEN '<' WHEN e = 'gt' THEN '>' WHEN e = 'amp' THEN '&' WHEN e = 'quot' THEN '"' WHEN e = 'apos' THEN chr(39) WHEN code BETWEEN 0 AND 55295 OR code BETWEEN 57344 AND 1114111 THEN chr(code::INT) ELSE '&' || e || ';' END, '' ORDER BY n) AS html FROM d GROUP BY 1""",
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(values(spark, ENTITY_ROWS, "page_id, html").withColumn("page_id", F.col("page_id").cast("long")))
    return rows.select("page_id", T.decode_entities(F.col("html")).alias("html"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.merge_sources(sources(spark, sf_dir, 0), sources(spark, sf_dir, 1))
    one = F.struct("pos", "url", "provider", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("published_date"), "content")
    lists = s.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return lists.select("session_id", F.repeat(F.lit("answer "), 20).alias("answer"), F.transform("x", lambda e: F.struct(*(e[c].alias(c) for c in S.SOURCE))).alias("sources"))


SQL_NOTE = lambda what: f"""'_[{what}: response budget reached - full text via web_fetch("' || x.out[1].url || '") or get_sources(session_id="' || x.sid || '", offset=' || x.i || ', limit=1)]_'"""
#: The budget as two folds over a session's sources from the last one on: content is cut or left out, then whole sources go.
SQL_BUDGET = f"""WITH {SQL_MERGED}, s AS (SELECT session_id, 140 + sum(64 + length(url) + length(provider) + length(content))::BIGINT AS total, list({{'url': url, 'provider': provider, 'content': content}} ORDER BY pos) AS src FROM m GROUP BY 1),
f AS (SELECT session_id, total > 2000 AS truncated, list_reduce(list_prepend({{'total': total, 'out': []::STRUCT(url VARCHAR, provider VARCHAR, content VARCHAR)[], 'i': 0::BIGINT, 'sid': session_id}}, list_reverse(list_transform(src, lambda e, k: {{'total': 0::BIGINT, 'out': [e], 'i': k - 1, 'sid': session_id}}))), lambda a, x:
  CASE WHEN a.total <= 2000 OR length(x.out[1].content) <= length({SQL_NOTE('inline content omitted')}) THEN {{'total': a.total, 'out': list_concat(x.out, a.out), 'i': 0::BIGINT, 'sid': a.sid}}
  WHEN length(x.out[1].content) > a.total - 2000 + length({SQL_NOTE('truncated')}) + 2 THEN {{'total': 2000::BIGINT, 'out': list_prepend({{'url': x.out[1].url, 'provider': x.out[1].provider, 'content': left(x.out[1].content, length(x.out[1].content) - (a.total - 2000) - length({SQL_NOTE('truncated')}) - 2) || chr(10) || chr(10) || {SQL_NOTE('truncated')}}}, a.out), 'i': 0::BIGINT, 'sid': a.sid}}
  ELSE {{'total': a.total + length({SQL_NOTE('inline content omitted')}) - length(x.out[1].content), 'out': list_prepend({{'url': x.out[1].url, 'provider': x.out[1].provider, 'content': {SQL_NOTE('inline content omitted')}}}, a.out), 'i': 0::BIGINT, 'sid': a.sid}} END) AS r FROM s),
d AS (SELECT session_id, truncated, r.out AS out, list_reduce(list_prepend({{'total': r.total, 'n': len(r.out)}}, list_reverse(list_transform(r.out, lambda e: {{'total': (64 + length(e.url) + length(e.provider) + length(e.content))::BIGINT, 'n': 0::BIGINT}}))), lambda a, x: CASE WHEN a.total > 2000 AND a.n > 1 THEN {{'total': a.total - x.total, 'n': a.n - 1}} ELSE a END) AS z FROM f)
SELECT session_id, z.total AS total, truncated, z.n::INT AS n_sources, sha256(array_to_string(list_transform(out[1:z.n], lambda e: e.url || chr(1) || e.content), chr(2))) AS digest FROM d"""


@query("f6_response_budget", SQL_BUDGET)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session."""
    out = S.apply_budget(sessions(spark, sf_dir), 2000)
    content = F.array_join(F.transform("sources", lambda s: F.concat(s["url"], F.lit("\u0001"), s["content"])), "\u0002")
    return out.select("session_id", "total", "truncated", F.size("sources").alias("n_sources"), F.sha2(content, 256).alias("digest"))


CITED = ["See [[1]](https://a.example/x) and [[22]](http://b.example/y).", "none", "[[x]](https://no)", "[[3]](ftp://no) [[4]](https://c.example/z<b)", ""]
CITED_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CITED))


@query("p3_inline_citations", f"SELECT id, unnest(regexp_extract_all(c, '\\[\\[\\d+\\]\\]\\((https?://[^ \\n\\t\\[<)]*)\\)', 1)) AS url FROM {by_page_sql(CITED_ROWS, "id, c", "c")} v")
def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, CITED_ROWS, "id, c", "c").select("id", F.explode(F.regexp_extract_all("c", F.lit(r"\[\[\d+\]\]\((https?://[^ \n\t\[<)]*)\)"), F.lit(1))).alias("url"))


MATERIALS = ["code at https://github.com/a/b, data (https://zenodo.org/record/1).", "https://huggingface.co/datasets/x https://huggingface.co/spaces/y https://huggingface.co/z/", "see http://lib.readthedocs.io/en/ and https://my-project.example/", "HTTPS://GITHUB.com/a/b https://github.com/a/b", "nothing", "https://arxiv.org/e-print/2 https://other.example/e-print/2 https://arxiv.org/src/3"]
MATERIAL_ROWS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MATERIALS))


@query(
    "s5_material_links",
    f"""WITH t AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(t, '\\s+'), lambda w: rtrim(trim(w, '"''()[]{{}}<>,.;'), '/')), lambda w: regexp_matches(w, '^https?://'))) AS url FROM {by_page_sql(MATERIAL_ROWS, "id, t", "t")} v),
k AS (SELECT DISTINCT id, url, lower(url) AS u FROM t), c AS (SELECT id, url, CASE WHEN contains(u, 'github.com/') OR contains(u, 'gitlab.com/') THEN 'code' WHEN contains(u, 'huggingface.co/') AND contains(u, '/datasets/') THEN 'dataset' WHEN contains(u, 'huggingface.co/') AND contains(u, '/spaces/') THEN 'demo' WHEN contains(u, 'huggingface.co/') THEN 'model' WHEN contains(u, 'paperswithcode.com/') THEN 'code' WHEN contains(u, 'zenodo.org/') OR contains(u, 'figshare.com/') THEN 'dataset' WHEN contains(u, 'arxiv.org/src/') OR contains(u, 'arxiv.org/e-print/') THEN 'supplement' WHEN contains(u, 'colab.research.google.com/') THEN 'demo' WHEN contains(u, 'docs.') OR contains(u, '/docs') OR contains(u, 'readthedocs.io/') THEN 'documentation' WHEN contains(u, 'project') OR contains(u, 'demo') OR contains(u, 'dataset') OR contains(u, 'code') THEN 'project' END AS kind FROM k)
SELECT id, url, kind, CASE WHEN kind IN ('code', 'dataset', 'model', 'demo', 'supplement') THEN 'high' WHEN kind = 'documentation' THEN 'medium' WHEN kind IS NOT NULL THEN 'low' END AS confidence FROM c WHERE kind IS NOT NULL""",
)
def material_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_page(spark, sf_dir, MATERIAL_ROWS, "id, t", "t").select("id", F.explode(F.array_distinct(U.url_tokens(F.col("t")))).alias("url"))
    kind = U.material_kind(F.col("url"))
    return rows.select("id", "url", kind.alias("kind"), U.material_confidence(kind).alias("confidence")).where("kind is not null")


@query("s21_byte_ranges", "SELECT page_id, len(range(0, n, 1024)) AS n_ranges, n - 1 AS last FROM (SELECT page_id, octet_length(encode(html))::BIGINT AS n FROM pages)")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = U.byte_ranges(F.octet_length("html").cast("long"), 1024)
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", F.size("r").cast("long").alias("n_ranges"), F.element_at("r", -1)["last"].alias("last"))


SQL_ADDRESS = "CASE page_id % 8 WHEN 0 THEN 'mailto:a@b.example' WHEN 1 THEN 'http://' WHEN 2 THEN 'no address ü' WHEN 3 THEN 'HTTPS://User:pw@Host.Example:8080?q=1#f' WHEN 4 THEN 'file:///tmp/' || CAST(page_id AS STRING) WHEN 5 THEN 'https://[2001:db8::1]/p;x?y' ELSE url END"


@query(
    "s16_url_summary",
    f"""WITH u AS (SELECT page_id AS id, page_id % 8 AS k, {SQL_ADDRESS} AS url, CASE WHEN page_id % 8 IN (1, 2) THEN false ELSE true END AS valid FROM pages), p AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS own, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS rest FROM u)
SELECT id, valid, CASE k WHEN 0 THEN 'mailto' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'https' WHEN 4 THEN 'file' WHEN 5 THEN 'https' ELSE split_part(url, ':', 1) END AS scheme, CASE k WHEN 3 THEN 'host.example' WHEN 5 THEN '[2001:db8::1]' WHEN 6 THEN own WHEN 7 THEN own END AS host,
  CASE k WHEN 0 THEN 'a@b.example' WHEN 3 THEN '/' WHEN 4 THEN '/tmp/' || id WHEN 5 THEN '/p;x' WHEN 6 THEN coalesce(nullif(rest, ''), '/') WHEN 7 THEN coalesce(nullif(rest, ''), '/') END AS path, CASE WHEN NOT valid THEN octet_length(encode(url))::BIGINT END AS n_bytes, CASE k WHEN 3 THEN 'HTTPS://***@Host.Example:8080?q=1#f' ELSE url END AS redacted FROM p""",
)
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id AS id", f"{SQL_ADDRESS} AS url")
    return rows.select("id", U.url_summary(F.col("url")).alias("s"), U.redact_credentials(F.col("url")).alias("redacted")).select("id", "s.*", "redacted")
