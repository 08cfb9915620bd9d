"""Parsers of chat-completion answers, extracted and scraped page bodies, and full-text locations, over raw JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.payloads import INLINE


def _is(value: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({value}) LIKE '{kind}%', false)"


def _member(value: str, key: str) -> str:
    return f"try_variant_get({value}, '$.{key}', 'variant')"


def _text(value: str) -> str:
    """A variant's text if it is a string."""
    return f"CASE WHEN {_is(value, 'STRING')} THEN CAST({value} AS STRING) END"


def _first_text(value: str, *keys: str) -> str:
    """The text under the first of the keys that is there, even if that is no text."""
    there = f"json_object_keys(to_json({value}))"
    return "CASE " + " ".join(f"WHEN array_contains({there}, '{k}') THEN {_text(_member(value, k))}" for k in keys) + " END"


def _items(value: str) -> str:
    """A list's items; an object is its only item; nothing else has any."""
    return f"CASE WHEN {_is(value, 'ARRAY')} THEN try_variant_get({value}, '$', 'array<variant>') WHEN {_is(value, 'OBJECT')} THEN array({value}) END"


def chat_answers(payloads: DataFrame) -> DataFrame:
    """payloads (id, raw) -> id, content: a string, an object's text, or a line for each textual part of a list; trimmed."""
    part = f"CASE WHEN {_is('p', 'STRING')} THEN CAST(p AS STRING) WHEN {_is('p', 'OBJECT')} THEN {_first_text('p', 'text', 'content', 'value')} END"
    parts = f"array_join(filter(transform(try_variant_get(c, '$', 'array<variant>'), p -> {part}), t -> t IS NOT NULL), '\\n')"
    return payloads.sparkSession.sql(
        f"""
WITH m AS (SELECT id, try_variant_get(try_parse_json(raw), '$.choices[0].message.content', 'variant') AS c FROM {{payloads}})
SELECT id, coalesce(trim(CASE WHEN {_is('c', 'STRING')} THEN CAST(c AS STRING) WHEN {_is('c', 'ARRAY')} THEN {parts} WHEN {_is('c', 'OBJECT')} THEN {_first_text('c', 'text', 'content', 'value')} END), '') AS content FROM m""",
        payloads=payloads,
    )


#: Where an answer lists its sources, in order.
SOURCE_PATHS = ["$.choices[0].message.annotations", "$.choices[0].message.citations", "$.citations", "$.search_sources"]


def chat_sources(payloads: DataFrame) -> DataFrame:
    """payloads (id, raw) -> id, pos, url, title, description, published_date: http(s) sources, the first of each URL, in path order; links in the text last."""
    lists = "\nUNION ALL ".join(f"SELECT id, {n} AS path, s.pos AS n, s.col AS item FROM (SELECT id, try_variant_get(v, '{p}', 'variant') AS x FROM p), LATERAL posexplode({_items('x')}) AS s" for n, p in enumerate(SOURCE_PATHS))
    return payloads.sparkSession.sql(
        f"""
WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {{payloads}}), l AS ({lists}),
o AS (SELECT id, path, n, item, CASE WHEN {_is('item', 'OBJECT')} THEN coalesce({_member('item', 'url_citation')}, item) END AS o FROM l),
s AS (
  SELECT id, path, n, CASE WHEN o IS NULL THEN {_text('item')} ELSE {_first_text('o', 'url', 'uri', 'href', 'link')} END AS url, {_first_text('o', 'title', 'name')} AS title, {_first_text('o', 'description', 'snippet', 'content')} AS description, {_first_text('o', 'published_date', 'publishedDate')} AS published_date FROM o
  UNION ALL SELECT id, 9, s.pos, s.col, NULL, NULL, NULL FROM {{answers}}, LATERAL posexplode(regexp_extract_all(content, r'{INLINE}', 1)) AS s
), u AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY path, n) AS k FROM s WHERE url LIKE 'http://%' OR url LIKE 'https://%')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY path, n) - 1 AS BIGINT) AS pos, url, title, description, published_date FROM u WHERE k = 1""",
        payloads=payloads,
        answers=chat_answers(payloads),
    )


def _solid(text: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN {text} END"


def extracted_body(payloads: DataFrame) -> DataFrame:
    """id, body: the first result's raw content, else its content; blank counts as none."""
    item = _member("try_parse_json(raw)", "results[0]")
    return payloads.sparkSession.sql(f"WITH p AS (SELECT id, {item} AS r FROM {{payloads}}), t AS (SELECT id, {_first_text('r', 'raw_content', 'content')} AS body FROM p) SELECT id, {_solid('body')} AS body FROM t", payloads=payloads)


def scraped_body(payloads: DataFrame) -> DataFrame:
    """id, body: the data's markdown or content, else the answer's own; the first key that is there decides; blank counts as none."""
    within, own = _first_text("d", "markdown", "content"), _first_text("v", "markdown", "content")
    has = "arrays_overlap(coalesce(json_object_keys(to_json(d)), array()), array('markdown', 'content'))"
    return payloads.sparkSession.sql(
        f"WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {{payloads}}), q AS (SELECT id, v, {_member('v', 'data')} AS d FROM p), t AS (SELECT id, CASE WHEN {has} THEN {within} ELSE {own} END AS body FROM q) SELECT id, {_solid('body')} AS body FROM t",
        payloads=payloads,
    )


def open_location(rows: DataFrame) -> DataFrame:
    """rows (id, email, doi, raw) -> id, url, source, status of the best open-access location; asked only with an e-mail and a DOI."""
    best = _member("try_parse_json(raw)", "best_oa_location")
    found = rows.where("email IS NOT NULL AND doi IS NOT NULL")
    return found.sparkSession.sql(f"WITH b AS (SELECT id, {best} AS b FROM {{rows}}), u AS (SELECT id, {_first_text('b', 'url_for_pdf', 'url')} AS url FROM b) SELECT id, url, 'unpaywall' AS source, 'unpaywall_oa_pdf' AS status FROM u WHERE url IS NOT NULL", rows=found)


def hidden_article_url(html: Column) -> Column:
    """The first direct article address in a page's script, entities undone."""
    return F.replace(F.nullif(F.regexp_extract(html, r"(https://mp\.weixin\.qq\.com/s\?[^'\"<>\\ ]*)", 1), F.lit("")), F.lit("&amp;"), F.lit("&"))
