"""Registered queries of chat answers, page bodies, the fetch path, fallbacks and rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import options as O
from lodeworks.operators import fetching as FT
from lodeworks.operators import rendering as RD
from lodeworks.operators import structure as S
from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql, count_rows, over
from lodeworks.sources import chat as C
from lodeworks.sources.tables import table, values


def _rows(items: list[str | None]) -> str:
    return ", ".join(f"({i}, " + ("NULL" if x is None else f"'{x}'") + ")" for i, x in enumerate(items))


CHATS = [
    '{"choices":[{"message":{"content":" plain answer [[1]](https://one.example/a) ","annotations":[{"type":"url_citation","url_citation":{"url":"https://two.example/b","title":"Two","content":"about"}},"https://three.example/c","ftp://no.example"],"citations":["https://two.example/b",{"uri":"https://four.example/d","name":"Four","snippet":"s","publishedDate":"2024-01-02"}]}}],"citations":{"href":"https://five.example/e"},"search_sources":[{"link":"https://six.example/f","url":null},{"url":7},{"title":"no address"}]}',
    '{"choices":[{"message":{"content":[{"type":"text","text":"first"},"second",{"content":"third"},{"text":null,"content":"hidden"},5]}}]}',
    '{"choices":[{"message":{"content":{"value":"from an object"}}}],"search_sources":["http://seven.example/g"]}',
    '{"choices":[{"message":{"content":null}}]}',
    "no json",
    None,
]
CHAT_TEXTS = "(0, 'plain answer [[1]](https://one.example/a)'), (1, 'first' || chr(10) || 'second' || chr(10) || 'third'), (2, 'from an object'), (3, ''), (4, ''), (5, '')"


@query("p2_chat_answers", f"SELECT * FROM (VALUES {CHAT_TEXTS}) v(id, content)")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chat_answers(values(spark, _rows(CHATS), "id, raw"))


@query(
    "a2_chat_sources",
    "SELECT * FROM (VALUES (0, 0::BIGINT, 'https://two.example/b', 'Two', 'about', NULL), (0, 1, 'https://three.example/c', NULL, NULL, NULL), (0, 2, 'https://four.example/d', 'Four', 's', '2024-01-02'), (0, 3, 'https://five.example/e', NULL, NULL, NULL), (0, 4, 'https://one.example/a', NULL, NULL, NULL), (2, 0, 'http://seven.example/g', NULL, NULL, NULL)) v(id, pos, url, title, description, published_date)",
)
def chat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chat_sources(values(spark, _rows(CHATS), "id, raw"))


#: Pages wrapped as an extraction service answers: some with raw content, some with content only, some blank.
@query(
    "p6_extracted_body",
    "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN url END AS body FROM pages",
)
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    item = F.when(kind == 0, F.to_json(F.struct(F.col("html").alias("raw_content"), F.lit("other").alias("content")))).when(kind == 1, F.to_json(F.struct(F.col("url").alias("content")))).when(kind == 2, F.to_json(F.struct(F.lit("  ").alias("raw_content"), F.col("url").alias("content")))).otherwise('{"raw_content":null,"content":"hidden"}')
    return C.extracted_body(p.select(F.col("page_id").alias("id"), F.concat(F.lit('{"results":['), item, F.lit("]}")).alias("raw")))


@query(
    "p7_scraped_body",
    "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN url WHEN 2 THEN html END AS body FROM pages",
)
def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('{"data":'), F.to_json(F.struct(F.col("html").alias("markdown"))), F.lit(',"markdown":"other"}'))).when(kind == 1, F.concat(F.lit('{"data":'), F.to_json(F.struct(F.col("url").alias("content"))), F.lit("}"))).when(kind == 2, F.to_json(F.struct(F.lit(1).alias("data"), F.col("html").alias("content")))).otherwise('{"data":{"markdown":" "},"content":"hidden"}')
    return C.scraped_body(p.select(F.col("page_id").alias("id"), raw.alias("raw")))


LOCATIONS = """(0, 'a@b.example', '10.5555/x', '{"best_oa_location":{"url_for_pdf":"https://p.example/x.pdf","url":"https://p.example/x"}}'), (1, 'a@b.example', '10.5555/y', '{"best_oa_location":{"url":"https://p.example/y"}}'), (2, 'a@b.example', '10.5555/z', '{"best_oa_location":{"url_for_pdf":null,"url":"https://p.example/z"}}'), (3, NULL, '10.5555/x', '{"best_oa_location":{"url":"https://p.example/x"}}'), (4, 'a@b.example', NULL, '{"best_oa_location":{"url":"https://p.example/x"}}'), (5, 'a@b.example', '10.5555/w', '{"best_oa_location":null}')"""


@query("a12_open_location", f"SELECT * FROM {by_page_sql("(0, 'https://p.example/x.pdf', 'unpaywall', 'unpaywall_oa_pdf'), (1, 'https://p.example/y', 'unpaywall', 'unpaywall_oa_pdf')", 'id, url, source, status', 'url', turns=count_rows(LOCATIONS))} v")
def open_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.open_location(by_page(spark, sf_dir, LOCATIONS, "id, email, doi, raw", "raw"))


@query("t20_hidden_article_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://mp.weixin.qq.com/s?a=' || page_id || '&b=1' END AS found FROM pages")
def hidden_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("html"), F.lit("var u = 'https://mp.weixin.qq.com/s?a="), F.col("page_id").cast("string"), F.lit("&amp;b=1'; x = \"https://mp.weixin.qq.com/s?c=2\""))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", C.hidden_article_url(html).alias("found"))


#: Pages as fetched: a kind, what the specialist rendered or why it failed, what two generic providers gave.
SQL_FETCHED = "f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'generic' WHEN 1 THEN 'arxiv' ELSE 'wikipedia' END AS kind, CASE page_id % 5 WHEN 1 THEN html WHEN 2 THEN '  ' WHEN 4 THEN 'unused' END AS special, CASE page_id % 5 WHEN 4 THEN 'timed out' END AS error, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END AS primary_, CASE WHEN page_id % 7 <> 0 THEN html END AS fallback FROM pages), r AS (SELECT *, CASE WHEN kind = 'generic' THEN NULL WHEN error IS NOT NULL THEN kind || ' ' || error WHEN trim(coalesce(special, '')) = '' THEN kind || ' empty render' END AS reason FROM f), c AS (SELECT *, CASE WHEN kind <> 'generic' AND reason IS NULL THEN special ELSE coalesce(CASE WHEN trim(primary_) <> '' THEN primary_ END, CASE WHEN trim(fallback) <> '' THEN fallback END) END AS whole FROM r)"


@query("t2_fetch_path", f"WITH {SQL_FETCHED} SELECT page_id, left(whole, 500) AS content, CASE WHEN kind <> 'generic' AND reason IS NULL THEN kind ELSE 'generic' END AS source_type, reason AS fallback_reason, length(whole)::BIGINT AS original_length, length(whole) > 500 AS truncated, whole IS NULL AS failed FROM c")
def fetch_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: F.col("page_id") % m
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(n(5) == 0, "generic").when(n(5) == 1, "arxiv").otherwise("wikipedia").alias("kind"), F.when(n(5) == 1, F.col("html")).when(n(5) == 2, "  ").when(n(5) == 4, "unused").alias("special"),
        F.when(n(5) == 4, "timed out").alias("error"), F.when(n(3) == 0, " ").otherwise(F.col("url")).alias("primary"), F.when(n(7) != 0, F.col("html")).alias("fallback"),
    )
    return FT.fetched_pages(pages, 500)


SQL_SESSIONS = "s AS (SELECT (page_id // 10)::VARCHAR AS session_id, page_id AS pos, url FROM pages)"


@query("f3_slices", f"WITH {SQL_SESSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM s) SELECT session_id, pos, url, 'enrichment' AS path, CASE WHEN session_id::BIGINT % 2 = 0 THEN 'tavily_enrichment' ELSE 'firecrawl_enrichment' END AS label FROM n WHERE n <= 3 UNION ALL SELECT session_id, pos, url, 'fallback', CASE WHEN session_id::BIGINT % 2 = 0 THEN 'tavily_fallback' ELSE 'firecrawl_enrichment' END FROM n WHERE n <= 5")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request's sources cut for both paths, with the labels of their origins."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("string").alias("session_id"), F.col("page_id").alias("pos"), "url")
    origin = F.when(F.col("session_id").cast("long") % 2 == 0, "primary").otherwise("fallback")
    return FT.sliced(p, 3, 5).withColumn("label", FT.provider_label(F.col("path"), origin))


@query("n10_fallback_message", "SELECT conv_id, turn, CASE WHEN trim(coalesce(a, '')) = '' THEN 'No answer by the answer provider could be checked. A second search found ' || turn || ' source(s), listed for your own reading.' ELSE 'An answer by the answer provider names no source and is left out. A second search found ' || turn || ' source(s), listed for your own reading.' END AS message FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text WHEN turn % 3 = 0 THEN ' ' END AS a FROM conversations)")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("turn") % 2 == 0, F.col("text")).when(F.col("turn") % 3 == 0, " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", FT.fallback_message(answer, F.col("turn")).alias("message"))


@query("t4_citation_sources", "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || ',c' WHEN 1 THEN '' WHEN 2 THEN 'd' ELSE '' END AS providers FROM pages")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = "CASE page_id % 4 WHEN 0 THEN array(concat('a', page_id), 'openalex_reference', 'c') WHEN 1 THEN array('openalex_reference') WHEN 2 THEN array('d') ELSE array() END AS providers"
    rows = table(spark, sf_dir, "pages").selectExpr("page_id AS id", lists)
    structs = F.transform("providers", lambda p: F.struct(p.alias("provider"), F.lit("u").alias("url")))
    return rows.select("id", F.array_join(F.transform(FT.without_reference_sources(structs), lambda s: s["provider"]), ",").alias("providers"))


ISSUES = "(0, 'Bug', 'closed', true, false, 'ann', array('x', 'y'), 'body'), (1, 'Ask', 'open', false, CAST(NULL AS boolean), 'eve', array(), NULL), (2, 'Merge', 'closed', true, true, 'bob', array(), 'b'), (3, 'Done', 'closed', false, CAST(NULL AS boolean), 'cy', array('z'), '')"
TALK = "(0, 0, 'bob', 'second', '2024-02-01'), (0, 1, 'cy', 'first', '2024-01-01'), (2, 0, 'di', 'only', '2024-05-01')"
INLINE = "(0, 0, 'di', 'on a line', '2024-01-15')"
REVIEWS = "(0, 0, 'ed', 'looks good', '2024-01-15'), (0, 1, 'ed', '  ', '2024-01-01')"
COMMENT_COLUMNS = "issue_id, pos, author, body, created_at"
SQL_FEEDS = f"c AS (SELECT *, 0 AS feed FROM (VALUES {TALK}) v({COMMENT_COLUMNS}) UNION ALL SELECT *, 1 FROM (VALUES {INLINE}) v({COMMENT_COLUMNS}) UNION ALL SELECT *, 2 FROM (VALUES {REVIEWS}) v({COMMENT_COLUMNS}) WHERE trim(body) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY created_at, feed, pos) AS n, count(*) OVER (PARTITION BY issue_id) AS total FROM c), m AS (SELECT issue_id, any_value(total) AS total, string_agg('### Comment by ' || author || ' (' || created_at || ')' || chr(10) || chr(10) || body || chr(10) || chr(10), '' ORDER BY n) FILTER (n <= 2) AS shown FROM k GROUP BY 1)"


@query("a15_comment_feeds", f"WITH {SQL_FEEDS} SELECT issue_id, string_agg(author || ':' || body, '|' ORDER BY n) AS comments FROM k GROUP BY 1")
def comment_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = RD.merge_comments(*(values(spark, r, COMMENT_COLUMNS) for r in (TALK, INLINE, REVIEWS)))
    return c.select("issue_id", F.array_join(F.transform("comments", lambda x: F.concat(x["author"], F.lit(":"), x["body"])), "|").alias("comments"))


@query(
    "n4_render_issue",
    f"""WITH i AS (SELECT * FROM (VALUES {ISSUES.replace("array(", "list_value(")}) v(id, title, state, is_pr, merged, author, labels, body)), {SQL_FEEDS}
SELECT id, '# ' || title || chr(10) || chr(10) || '**State:** ' || state || CASE WHEN is_pr AND coalesce(merged, false) THEN ' (merged)' WHEN is_pr AND state = 'closed' THEN ' (closed, not merged)' ELSE '' END || chr(10) || '**Author:** ' || author || chr(10) || CASE WHEN len(labels) > 0 THEN '**Labels:** ' || array_to_string(labels, ', ') || chr(10) ELSE '' END || chr(10) || coalesce(body, '') || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || coalesce(shown, '') || CASE WHEN total > 2 THEN '_还有 ' || (total - 2) || ' 条评论_' || chr(10) ELSE '' END AS markdown FROM i LEFT JOIN m ON id = issue_id""",
)
def issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = RD.merge_comments(*(values(spark, r, COMMENT_COLUMNS) for r in (TALK, INLINE, REVIEWS)))
    none = F.array().cast("array<struct<author:string,created_at:string,body:string>>")
    v = values(spark, ISSUES, "id, title, state, is_pr, merged, author, labels, body").withColumn("labels", F.col("labels").cast("array<string>")).join(comments, F.col("id") == F.col("issue_id"), "left").withColumn("comments", F.coalesce("comments", none))
    return v.select("id", RD.render_issue(*(F.col(c) for c in ("title", "state", "is_pr", "merged", "author", "labels", "body", "comments")), 2).alias("markdown"))


REPOSITORIES = "(0, 'o/r', 'A repository', 'main', 12, 3, 'MIT', '  # Readme ' || chr(10)), (1, 'o/s', ' ', 'dev', 0, 0, NULL, NULL)"


@query("n5_render_repository", f"SELECT id, '# ' || name || chr(10) || chr(10) || CASE WHEN trim(about) <> '' THEN about || chr(10) || chr(10) ELSE '' END || '**Default branch:** ' || branch || chr(10) || '**Stars:** ' || stars || chr(10) || '**Forks:** ' || forks || chr(10) || coalesce('**License:** ' || license || chr(10), '') || chr(10) || '## README' || chr(10) || chr(10) || regexp_replace(coalesce(readme, ''), '^\\s+|\\s+$', '', 'g') || chr(10) AS markdown FROM {by_page_sql(REPOSITORIES, "id, name, about, branch, stars, forks, license, readme", "about, readme")} v")
def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = by_page(spark, sf_dir, REPOSITORIES, "id, name, about, branch, stars, forks, license, readme", "about, readme")
    return v.select("id", RD.render_repository(*(F.col(c) for c in ("name", "about", "branch", "stars", "forks", "license", "readme"))).alias("markdown"))


ANSWERS = "(1, 0, false, 10, 'a', 'first', array(struct('x', 'unseen'))), (1, 1, true, 2, 'b', 'second', array(struct('u', 'one'), struct('v', 'two'), struct('w', 'three'))), (1, 2, false, 10, 'c', 'third', array()), (2, 0, NULL, 1, 'd', 'only', array())"


@query(
    "n6_render_question",
    """SELECT * FROM (VALUES (1, replace('# Q1||body||---||## ★ 采纳答案 (↑2)||second||> **u:** one|> **v:** two|_还有 1 条评论_||## 答案 by a (↑10)||first||_还有 1 条_|', '|', chr(10))), (2, replace('# Q2||body||---||## 答案 by d (↑1)||only||', '|', chr(10)))) v(question_id, markdown)""",
)
def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<author:string,body:string>>"
    a = S.order_answers(values(spark, ANSWERS, "question_id, pos, accepted, score, author, body, comments").withColumn("comments", F.col("comments").cast(kind)))
    lists = a.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("accepted", F.lit(False)).alias("accepted"), "score", "author", "body", "comments"))).alias("answers"))
    return lists.select("question_id", RD.render_question(F.concat(F.lit("Q"), F.col("question_id")), F.lit("body"), F.col("answers"), 2, 2).alias("markdown"))


@query("n7_render_pages", "SELECT doc_id, '# ' || left(text, 40) || chr(10) || chr(10) || '**Authors:** ' || lang || ', ' || source || chr(10) || chr(10) || '**Categories:** ' || lang || chr(10) || chr(10) || '**Links:** [Abstract](a) | [PDF](p)' || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || text || chr(10) AS paper, '# ' || lang || chr(10) || chr(10) || text || chr(10) AS article FROM documents")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    paper = RD.render_paper(F.left("text", F.lit(40)), F.array("lang", "source"), F.array("lang"), F.lit("a"), F.lit("p"), F.col("text"))
    return d.select("doc_id", paper.alias("paper"), RD.render_article(F.col("lang"), F.col("text")).alias("article"))


OPTIONS = [(None, None), ("", " CITATIONS "), ("Broad", "date"), ("precise", "best"), ("fast", "relevance")]
OPTION_ROWS = ", ".join("({}, {}, {})".format(i, *("NULL" if x is None else f"'{x}'" for x in o)) for i, o in enumerate(OPTIONS))


@query("s8_search_options", f"SELECT id, CASE WHEN trim(coalesce(mode, '')) = '' THEN 'balanced' WHEN lower(trim(mode)) IN ('balanced', 'broad', 'precise') THEN lower(trim(mode)) END AS mode, CASE WHEN trim(coalesce(sort, '')) = '' THEN 'relevance' WHEN lower(trim(sort)) IN ('relevance', 'citations', 'date') THEN lower(trim(sort)) END AS sort FROM {by_page_sql(OPTION_ROWS, "id, mode, sort", "")} v")
def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, OPTION_ROWS, "id, mode, sort", "").select("id", O.one_of(F.col("mode"), O.SEARCH_MODES).alias("mode"), O.one_of(F.col("sort"), O.ORDERS).alias("sort"))


@query("s8_selected_sources", f"SELECT * FROM {by_page_sql("(0, 'dblp,semantic,arxiv'), (1, 'dblp,semantic,arxiv,openalex,crossref'), (2, 'semantic,arxiv,semantic'), (3, NULL), (4, '')", 'id, sources')} v")
def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_page(spark, sf_dir, "(0, array(), 'precise'), (1, array(), 'broad'), (2, array('S2, arxiv', ' Semantic_Scholar '), 'broad'), (3, array('arxiv', 'pubmed'), 'broad'), (4, array(' , '), 'precise')", "id, asked, mode")
    return rows.select("id", F.array_join(O.selected_sources(F.col("asked").cast("array<string>"), F.col("mode")), ",").alias("sources"))


@query("s7_session_key", "SELECT item_id, left(sha256(text), 12) AS session FROM benchmark")
def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", O.session_key(F.col("text")).alias("session"))


LOCATORS = "(0, 'u', NULL, ''), (1, 'u', 'd', NULL), (2, NULL, NULL, NULL), (3, ' ', 'd', '  ')"


@query("e16_exactly_one", f"SELECT id, (trim(coalesce(a, '')) <> '')::INT + (trim(coalesce(b, '')) <> '')::INT + (trim(coalesce(c, '')) <> '')::INT = 1 AS valid FROM {by_page_sql(LOCATORS, "id, a, b, c", "")} v")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, LOCATORS, "id, a, b, c", "").select("id", O.exactly_one(F.col("a"), F.col("b"), F.col("c")).alias("valid"))


@query("e17_pdf_problem", "SELECT page_id, CASE WHEN octet_length(encode(b)) > 4000 THEN 'academic pdf exceeds max size: ' || octet_length(encode(b)) || ' > 4000' WHEN NOT starts_with(b, '%PDF') THEN 'resolved academic full text is not a PDF' END AS problem FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '%PDF-1.7 ' || html ELSE html END AS b FROM pages)")
def pdf_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).otherwise(F.col("html")), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", content.alias("b")).select("page_id", O.pdf_problem(F.col("b"), 4000).alias("problem"))


ARTICLES = "(0, 'https://a.example/1', '/link?x', 's', 'd', 't'), (1, ' ', '//list.example/2', 's', 'd', 't'), (2, NULL, '', 's', NULL, 't'), (3, 'https://a.example/1', 'plain', 's2', 'd', 't'), (4, NULL, NULL, 's', '', 't'), (5, NULL, 'http://c.example', 's', 'd', 't')"
SQL_ARTICLE_KEY = "coalesce(CASE WHEN trim(url) <> '' THEN url END, CASE WHEN trim(list_url) <> '' THEN list_url END, coalesce(source, '') || '|' || coalesce(date, '') || '|' || coalesce(title, ''))"


@query("c10_distinct_articles", f"SELECT id, CASE WHEN list_url LIKE '//%' THEN 'https:' || list_url WHEN list_url LIKE '/%' THEN 'https://base.example' || list_url ELSE list_url END AS list_url FROM {by_page_sql(ARTICLES, "id, url, list_url, source, date, title", "url, list_url")} v QUALIFY row_number() OVER (PARTITION BY {SQL_ARTICLE_KEY} ORDER BY id) = 1")
def distinct_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each key, with its list address made absolute."""
    rows = by_page(spark, sf_dir, ARTICLES, "id, url, list_url, source, date, title", "url, list_url")
    key = O.article_key(*(F.col(c) for c in ("url", "list_url", "source", "date", "title")))
    first = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct("id", "list_url"), "id").alias("r"))
    return first.select("r.id", O.absolute_url(F.col("r.list_url"), "https://base.example").alias("list_url"))


HOSTS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'arxiv.org' WHEN 1 THEN 'Export' || CAST(page_id AS STRING) || '.arXiv.org' WHEN 2 THEN 'x.aclanthology.org' WHEN 3 THEN 'notarxiv.org' ELSE 'h' || CAST(page_id AS STRING) || '.example' END AS host, page_id % 3 = 0 AS direct FROM pages"


@query("s22_download_order", f"SELECT page_id, host, CASE WHEN regexp_matches(lower(host), '(^|[.])(arxiv[.]org|openaccess[.]thecvf[.]com|aclanthology[.]org)$') THEN 'current_range_parallel,current_full' ELSE 'current_full,current_range_parallel' END || CASE WHEN direct THEN ',direct_range_parallel,direct_full' ELSE '' END AS strategies FROM ({HOSTS})")
def download_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, HOSTS, "pages").select("page_id", "host", F.array_join(O.download_order(F.col("host"), F.col("direct")), ",").alias("strategies"))


@query("c12_distinct_strings", "SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS words FROM documents")
def distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.split("text", " ", -1))).alias("words"))


@query("e16_range_problems", "SELECT doc_id, CASE WHEN n_chars BETWEEN 100 AND 2000 THEN NULL ELSE 'max_chars must be between 100 and 2000' END AS problem FROM documents")
def range_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", O.range_problem(F.col("n_chars"), 100, 2000, "max_chars").alias("problem"))


@query("t3_mapped_urls", "SELECT page_id, len(u)::INT AS n, array_to_string(u, ' ') AS urls FROM (SELECT page_id, (list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: trim(x) <> ''))[1 : page_id % 7] AS u FROM pages)")
def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's links as a map of its site, cut to a limit by the page's number."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    rows = table(spark, sf_dir, "pages").select("page_id", O.mapped_urls(links, F.col("page_id") % 7).alias("u"))
    return rows.select("page_id", F.size("u").alias("n"), F.array_join("u", " ").alias("urls"))


@query("t11_structuring_input", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'sha-' || source ELSE sha256(text) END AS sha256 FROM documents")
def structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3 == 0
    chosen = O.structuring_input(F.when(third, F.upper("lang")), F.when(third, F.concat(F.lit("sha-"), "source")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.*")
