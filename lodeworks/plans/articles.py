"""Registered queries of the article search: lists, redirects and articles are made around every page's own HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.registry import query
from lodeworks.sources import articles as A
from lodeworks.sources.tables import table

SEARCHES = 20
ACCOUNT = "Account 1"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("search_id", F.col("page_id") % SEARCHES).withColumn("page", F.floor(F.col("page_id") / SEARCHES) + 1)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three results and a trap on each page: links relative, without scheme and whole, an item without a closing tag, one without a date."""
    item = """concat('<ul class="news"><li id="sogou_vr_11002601_box_0"><h3><a target="_blank" href="/link?url=', page_id % 50, '&amp;type=2">Title <em>', page_id, '</em> &lt;a&gt;</a></h3><p class="x txt-info">sum <b>mary</b>
 one</p><span class="all-time-y2">Account ', page_id % 3, '</span><span class="s2"><script>document.write(timeConvert(\\'', 1494483651 + page_id * 86400, '\\'))</script></span>',
'<li id="sogou_vr_11002601_box_1"><h3><a href="/other">B</a> <a target="_blank" href="//b.example/', page_id, '"><img src="x">', page_id, '</a></h3><p>not <p class="txt-info">two</p><span class="all-time-y2"> Account 1 </span></li>',
'<li id="sogou_vr_11002601_box_2"><div><h3>C</h3></div></li><li id="other"><h3><a target="_blank" href="/no">No</a></h3></li></ul>')"""
    empty = F.col("page_id") % 11 == 0
    html = F.when(empty, F.col("html")).otherwise(F.concat(F.col("html"), F.expr(item)))
    return _pages(spark, sf_dir).select("search_id", "page", F.col("page_id"), html.alias("html"))


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the address's number: joined by a script, whole in the page, without any; every seventh page is missing."""
    n = F.col("page_id")
    script = F.concat(F.lit("<script>var url = ''; url += 'https://mp.weixin'; url  +=\\n'.qq.com/s?src=11@&n=".replace("\\n", "\n")), n, F.lit("'; curl += ''; url += 'open</script>"))
    whole = F.concat(F.lit('<a href="https://mp.weixin.qq.com/s?n='), n, F.lit('&amp;k=1">go</a> https://mp.weixin.qq.com/s?later'))
    own = table(spark, sf_dir, "pages").where((n < 50) & (n % 7 != 0))
    return own.select(F.concat(F.lit("https://weixin.sogou.com/link?url="), n, F.lit("&type=2")).alias("list_url"), F.when(n % 3 == 0, script).when(n % 3 == 1, F.concat("html", whole)).otherwise(F.col("html")).alias("html"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://mp.weixin.qq.com/s?src=11&n="), n)).otherwise(F.concat(F.lit("https://mp.weixin.qq.com/s?n="), n, F.lit("&k=1")))
    first = F.concat(F.lit('<div id="js_content"> <p>First '), n, F.lit("<p>Second<br>line &amp; more</div><div class='rich_media_content'>never</div>"))
    second = F.concat(F.lit('<div id="js_content"> <br> </div><section class="a rich_media_content b">Rich '), n, F.lit("</section>"))
    third = F.concat(F.lit('<p id="page-content">no</p><div id="page-content">Page '), n, F.lit("</div>"))
    body = F.when(n % 4 == 0, first).when(n % 4 == 1, second).when(n % 4 == 2, third).otherwise(F.lit("<p>nothing</p>"))
    return table(spark, sf_dir, "pages").where(n < 50).select(url.alias("url"), F.concat("html", body).alias("html"))


SQL_LISTS = f"""r AS (
  SELECT page_id % {SEARCHES} AS search_id, page_id // {SEARCHES} + 1 AS page, page_id AS n, i AS pos FROM pages, range(3) t(i) WHERE page_id % 11 <> 0
), a AS (
  SELECT search_id, page, n, pos, CASE pos WHEN 0 THEN 'Title ' || n || ' <a>' WHEN 1 THEN 'B ' || n ELSE 'C' END AS title, CASE pos WHEN 0 THEN 'sum mary one' WHEN 1 THEN 'two' ELSE '' END AS snippet, CASE pos WHEN 0 THEN 'Account ' || n % 3 WHEN 1 THEN 'Account 1' ELSE '' END AS source,
    CASE WHEN pos = 0 THEN strftime(make_timestamp((1494483651 + n * 86400) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS published, CASE pos WHEN 0 THEN 'https://weixin.sogou.com/link?url=' || n % 50 || '&type=2' WHEN 1 THEN 'https://b.example/' || n ELSE '' END AS list_url FROM r
)"""
SQL_TARGET = "CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 3 = 0 THEN 'https://mp.weixin.qq.com/s?src=11&n=' || {k} WHEN {k} % 3 = 1 THEN 'https://mp.weixin.qq.com/s?n=' || {k} || '&k=1' END"
SQL_BODY = "CASE {k} % 4 WHEN 0 THEN 'First ' || {k} || ' Second line & more' WHEN 1 THEN 'Rich ' || {k} WHEN 2 THEN 'Page ' || {k} END"


def _sql_search(account: str | None, most: int, chars: int) -> str:
    return f"""WITH {SQL_LISTS}, u AS (
  SELECT *, CASE WHEN pos = 0 THEN {SQL_TARGET.format(k="(n % 50)")} END AS url, pos = 0 AND n % 50 % 7 <> 0 AS visited FROM a WHERE page <= 10 {f"AND source = '{account}'" if account else ""}
), d AS (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY search_id, coalesce(nullif(trim(url), ''), nullif(trim(list_url), ''), source || '|' || published || '|' || title) ORDER BY page, pos) = 1
), t AS (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY page, pos)::INT AS rank FROM d QUALIFY rank <= {most}
), b AS (
  SELECT *, CASE WHEN url IS NOT NULL THEN {SQL_BODY.format(k="(n % 50)")} END AS body FROM t
)
SELECT search_id, rank, title, snippet, source, published, url, list_url, left(body, {chars}) AS content, length(body)::BIGINT AS original_length, coalesce(length(body), 0) > {chars} AS truncated,
  CASE WHEN NOT visited THEN 'URL resolution failed,content skipped because URL was not resolved' WHEN url IS NULL THEN 'article URL not found,content skipped because URL was not resolved' WHEN body IS NULL THEN 'content fetch failed' ELSE '' END AS warnings FROM b"""


@query("p12_search_results", f"WITH {SQL_LISTS} SELECT search_id, page, pos, title, snippet, source, published, list_url FROM a")
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_results(_lists(spark, sf_dir))


@query("p12_redirects", f"SELECT 'https://weixin.sogou.com/link?url=' || k || '&type=2' AS list_url, {SQL_TARGET.format(k='k')} AS url FROM (SELECT page_id AS k FROM pages WHERE page_id < 50 AND page_id % 7 <> 0)")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redirects(spark, sf_dir).select("list_url", A.redirect_target(F.col("html")).alias("url"))


@query("p12_article_bodies", f"SELECT CASE WHEN k % 3 = 0 THEN 'https://mp.weixin.qq.com/s?src=11&n=' || k ELSE 'https://mp.weixin.qq.com/s?n=' || k || '&k=1' END AS url, {SQL_BODY.format(k='k')} AS content FROM (SELECT page_id AS k FROM pages WHERE page_id < 50)")
def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.article_bodies(_articles(spark, sf_dir))


def _search(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = A.article_search(_lists(spark, sf_dir), _redirects(spark, sf_dir), _articles(spark, sf_dir), **options)
    return found.withColumn("warnings", F.array_join("warnings", ","))


@query("a5_article_search", _sql_search(None, 12, 9))
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 articles of each search over its pages, with their resolved addresses and cut bodies."""
    return _search(spark, sf_dir, max_results=12, max_chars=9)


@query("a5_account_articles", _sql_search(ACCOUNT, 50, 500))
def account_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, account=f" {ACCOUNT} ", max_results=200, max_chars=500)


@query(
    "a5_search_reports",
    f"""WITH {SQL_LISTS}, e AS (SELECT page_id % {SEARCHES} AS search_id, page_id // {SEARCHES} + 1 AS page FROM pages WHERE page_id % 11 = 0),
f AS (SELECT search_id, count(*) AS articles FROM ({_sql_search("Account 2", 50, 500)}) GROUP BY 1), w AS (SELECT search_id, string_agg('page ' || page || ': no article results parsed', ',' ORDER BY page) AS warnings FROM e GROUP BY 1)
SELECT s.search_id, coalesce(f.articles, 0) AS articles, CASE WHEN w.warnings IS NULL AND f.articles IS NULL THEN 'no matching articles found' ELSE coalesce(w.warnings, '') END AS warnings
FROM (SELECT DISTINCT page_id % {SEARCHES} AS search_id FROM pages) s LEFT JOIN f USING (search_id) LEFT JOIN w USING (search_id)""",
)
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, account="Account 2", max_results=50)
    return A.search_reports(_lists(spark, sf_dir), found).select("search_id", F.col("articles").cast("long").alias("articles"), F.array_join("warnings", ",").alias("warnings"))
