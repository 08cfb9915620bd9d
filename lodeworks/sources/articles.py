"""Article search: result lists of a search engine, their redirect pages and the articles themselves, joined to one result.

What each page says is read from its element tree; which articles come out (account, address, first of each, how many) is joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.options import absolute_url, article_key
from lodeworks.sources.html_tree import Selector, first_text, select, tree

# Where the pages have what.
BASE = "https://weixin.sogou.com"
ITEM = Selector(tag="li", id_start="sogou_vr_11002601_box_")
TITLE, SNIPPET, SOURCE = Selector(tag="h3"), Selector(tag="p", cls="txt-info"), Selector(tag="span", cls="all-time-y2")
DATE, LINK = Selector(tag="script", within=Selector(tag="span", cls="s2")), Selector(tag="a", attr=("target", "_blank"))
BODIES = (Selector(id="js_content"), Selector(cls="rich_media_content"), Selector(tag="div", id="page-content"))
ARTICLE = "https://mp.weixin.qq.com/s?"
SECONDS = re.compile(r"timeConvert\('([+-]?\d+)'")
#: A garbled entity in joined addresses, and what it was.
GARBLED = ("src=11脳tamp", "src=11&timestamp")

MOST_RESULTS, MOST_PAGES = 50, 10


def search_results(pages: DataFrame) -> DataFrame:
    """pages (search_id, page, html) -> search_id, page, pos, title, snippet, source, published (UTC, empty if unknown), list_url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for search, page, html in zip(pdf["search_id"], pdf["page"], pdf["html"]):
                for pos, item in enumerate(select(tree(html), ITEM)):
                    script = next(select(item, DATE), None)
                    found = SECONDS.search(next(script.texts(), "")) if script is not None else None
                    link = next(select(item, LINK), None)
                    out.append((search, page, pos, *(first_text(item, s) for s in (TITLE, SNIPPET, SOURCE)), int(found[1]) if found else None, "" if link is None else link.attrs.get("href", "")))
            yield pd.DataFrame(out, columns=["search_id", "page", "pos", "title", "snippet", "source", "seconds", "href"]).astype({"seconds": "Int64"})

    rows = pages.select("search_id", "page", "html").mapInPandas(run, "search_id long, page long, pos long, title string, snippet string, source string, seconds long, href string")
    published = F.when(F.col("seconds") >= 0, F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd HH:mm:ss"))
    return rows.select("search_id", "page", "pos", "title", "snippet", "source", F.coalesce(published, F.lit("")).alias("published"), absolute_url(F.col("href"), BASE).alias("list_url"))


def redirect_target(html: Column) -> Column:
    """The address that a redirect page's script joins from pieces, else the first article's address in the page; null without."""
    joined = F.replace(F.array_join(F.regexp_extract_all(html, F.lit(r"(?U)url\s*\+=\s*'([^']*)'"), 1), ""), F.lit("@"), F.lit(""))
    direct = F.nullif(F.regexp_extract(html, re.escape(ARTICLE) + r"""[^'"<>\\ ]*""", 0), F.lit(""))
    return F.when(F.startswith(joined, F.lit(ARTICLE)), F.replace(joined, *map(F.lit, GARBLED))).otherwise(F.replace(direct, F.lit("&amp;"), F.lit("&")))


def article_bodies(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> url, content: of the first selector whose first element has text; null without."""

    def body(html: str | None) -> str | None:
        root = tree(html)
        return next((text for s in BODIES if (text := first_text(root, s))), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "content": [body(h) for h in pdf["html"]]})

    return pages.select("url", "html").mapInPandas(run, "url string, content string")


def article_search(pages: DataFrame, redirects: DataFrame, articles: DataFrame, account: str | None = None, max_results: int = 10, max_pages: int = MOST_PAGES, max_chars: int | None = None) -> DataFrame:
    """pages (search_id, page, html), redirects (list_url, html), articles (url, html) -> a search's articles in order.

    search_id, rank, title, snippet, source, published, url, list_url, content, original_length, truncated, warnings.  Only the account's
    articles, if one is asked for; the first of each address; max_results of a search.  An article that
    was not resolved or fetched stays, with a warning.  redirects and articles have one row for each address.
    """
    wanted = min(max(max_results, 1), MOST_RESULTS)
    rows = search_results(pages.where(F.col("page").between(1, min(max(max_pages, 1), MOST_PAGES))))
    if account and account.strip():
        rows = rows.where(F.trim("source") == account.strip())
    resolved = redirects.select("list_url", redirect_target(F.col("html")).alias("url"), F.lit(True).alias("visited"))
    rows = rows.join(resolved, "list_url", "left")
    place = F.struct("page", "pos")
    key = article_key(F.col("url"), F.col("list_url"), F.col("source"), F.col("published"), F.col("title"))
    first = F.row_number().over(Window.partitionBy("search_id", key).orderBy(place))
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy(place))
    rows = rows.withColumn("nth", first).where("nth = 1").withColumn("rank", rank).where(F.col("rank") <= wanted)
    rows = rows.join(article_bodies(articles.join(rows.select("url").distinct(), "url", "left_semi")), "url", "left")
    length = F.length("content").cast("long")
    content = F.col("content") if max_chars is None else F.left("content", F.lit(max_chars))
    warning = F.when(F.col("visited").isNull(), "URL resolution failed").when(F.col("url").isNull(), "article URL not found").when(F.col("content").isNull(), "content fetch failed")
    skipped = F.when(F.col("url").isNull(), "content skipped because URL was not resolved")
    return rows.select(
        "search_id", "rank", "title", "snippet", "source", "published", "url", "list_url", content.alias("content"), length.alias("original_length"),
        (F.coalesce(length, F.lit(0)) > (F.lit(max_chars) if max_chars is not None else F.lit(1 << 62))).alias("truncated"), F.array_compact(F.array(warning, skipped)).alias("warnings"),
    )


def search_reports(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages of search_results, found of article_search -> search_id, articles, warnings: pages without results, or that nothing matched."""
    lists = search_results(pages).groupBy("search_id", "page").agg(F.count("*").alias("n"))
    empty = pages.select("search_id", "page").distinct().join(lists, ["search_id", "page"], "left").groupBy("search_id").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("page")))).alias("empty"))
    counted = empty.join(found.groupBy("search_id").agg(F.count("*").alias("articles")), "search_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
    notes = F.transform("empty", lambda p: F.format_string("page %d: no article results parsed", p))
    none = F.when((F.size("empty") == 0) & (F.col("articles") == 0), F.array(F.lit("no matching articles found")))
    return counted.select("search_id", "articles", F.coalesce(none, notes).alias("warnings"))
