"""Registered queries of the payload parsers, over literal payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql, over
from lodeworks.sources import payloads as P
from lodeworks.sources.tables import table, values

ANSWERS = [
    '{"output":[{"action":{"sources":[{"url":"https://a.example/1","title":"A"},"https://b.example/2"]}},{"content":[{"text":" one [[1]](https://c.example/3) ","annotations":[{"uri":"https://d.example/4"},{"url":null,"uri":"https://e.example/5"}],"citations":["https://a.example/1"]},{"text":"two"},{"text":"one [[1]](https://c.example/3)"}]}],"citations":["https://f.example/6","https://b.example/2"]}',
    '{"output_text":"direct","citations":[{"url":"https://g.example/7","title":"G"},{"url":" "}]}',
    '{"output":[]}',
]
RESULTS = ['{"results":["https://a.example/1",{"url":"https://b.example/2","title":"B","content":"text b"},{"url":"https://c.example/3","description":"text c"},{"title":"no url"}]}', '{"data":[{"url":"https://d.example/4","description":"d"},{"url":"https://e.example/5","markdown":"m"}]}', "{}"]
PAPERS = ['{"title":"T1","paperId":"p1","year":2020,"citationCount":7,"authors":[{"name":"A B"},{"name":"C"}],"externalIds":{"DOI":"10.1/x"},"openAccessPdf":{"url":"https://p.example/1.pdf"}}', '{"title":"T2","paperId":"p2","openAccessPdf":null}', '{"title":"T3"}']
WORKS = ['{"id":"https://openalex.org/W1","display_name":"D1","doi":"https://doi.org/10.1/y","publication_year":2019,"cited_by_count":3,"referenced_works":["W2","W3"],"open_access":{"is_oa":true}}', '{"id":"W2","display_name":"D2"}']
CROSS = ['{"DOI":"10.1/z","title":["C1"],"author":[{"given":"Ada","family":"L"},{"family":"M"}],"published-online":{"date-parts":[[2018,1]]},"is-referenced-by-count":4}', '{"DOI":"10.1/w","title":["C2"],"published-print":{"date-parts":[[2016]]},"published-online":{"date-parts":[[2015]]}}']
REPOS = ['{"full_name":"a/b","description":"d","stargazers_count":5,"forks_count":1,"license":{"spdx_id":"NOASSERTION"}}', '{"full_name":"c/d","license":{"spdx_id":"MIT"}}']
MODELS = ['{"id":"org/sub/name","tags":["z","a","z"],"downloads":9,"likes":2}', '{"id":"solo","tags":[]}']


def _rows(payloads: list[str]) -> str:
    return ", ".join(f"({i}, '{p}')" for i, p in enumerate(payloads))


def _table(spark: SparkSession, sf_dir: str, payloads: list[str]) -> DataFrame:
    return by_page(spark, sf_dir, _rows(payloads), "id, raw", "raw")


SQL_URL = lambda v: f"CASE WHEN json_type({v}) = 'VARCHAR' THEN {v} ->> '$' WHEN list_contains(json_keys({v}), 'url') THEN {v} ->> '$.url' ELSE {v} ->> '$.uri' END AS url, CASE WHEN json_type({v}) <> 'VARCHAR' THEN {v} ->> '$.title' END AS title"

SQL_ITEMS = f"p AS (SELECT id, raw::JSON AS v FROM {by_page_sql(_rows(ANSWERS), "id, raw", "raw")} v), i AS (SELECT id, generate_subscripts(x, 1) - 1 AS a, unnest(x) AS item FROM (SELECT *, CAST(v -> '$.output' AS JSON[]) AS x FROM p)), c AS (SELECT id, a, generate_subscripts(x, 1) - 1 AS b, unnest(x) AS content FROM (SELECT *, CAST(item -> '$.content' AS JSON[]) AS x FROM i))"


@query(
    "p1_answer_sources",
    f"""WITH {SQL_ITEMS}, s AS (
  SELECT id, a, 0 AS path, 0 AS b, n, value FROM (SELECT id, a, generate_subscripts(x, 1) AS n, unnest(x) AS value FROM (SELECT *, CAST(item -> '$.action.sources' AS JSON[]) AS x FROM i))
  UNION ALL SELECT id, a, 1, b, n, value FROM (SELECT id, a, b, generate_subscripts(x, 1) AS n, unnest(x) AS value FROM (SELECT *, CAST(content -> '$.annotations' AS JSON[]) AS x FROM c))
  UNION ALL SELECT id, a, 2, b, n, value FROM (SELECT id, a, b, generate_subscripts(x, 1) AS n, unnest(x) AS value FROM (SELECT *, CAST(content -> '$.citations' AS JSON[]) AS x FROM c))
  UNION ALL SELECT id, 1000000, 3, 0, n, value FROM (SELECT id, generate_subscripts(x, 1) AS n, unnest(x) AS value FROM (SELECT *, CAST(v -> '$.citations' AS JSON[]) AS x FROM p))
  UNION ALL SELECT id, 1000000 + a, 4, b, n, to_json(value) FROM (SELECT id, a, b, generate_subscripts(x, 1) AS n, unnest(x) AS value FROM (SELECT *, regexp_extract_all(coalesce(content ->> '$.text', ''), '{P.INLINE}', 1) AS x FROM c))
), u AS (SELECT id, a, path, b, n, {SQL_URL('value')} FROM s), k AS (SELECT * FROM u WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY id, url ORDER BY a, path, b, n) = 1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, path, b, n) - 1 AS pos, url, title FROM k""",
)
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.answer_sources(_table(spark, sf_dir, ANSWERS))


@query("p1_answer_text", f"WITH {SQL_ITEMS}, d AS (SELECT id, x, min({{'a': a, 'b': b}}) AS k FROM (SELECT id, a, b, trim(content ->> '$.text', ' ') AS x FROM c) WHERE x <> '' GROUP BY 1, 2), j AS (SELECT id, string_agg(x, chr(10) ORDER BY k) AS parts FROM d GROUP BY 1) SELECT id, coalesce(nullif(trim(v ->> '$.output_text'), ''), parts, '') AS content FROM p LEFT JOIN j USING (id)")
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.answer_text(_table(spark, sf_dir, ANSWERS))


@query("p4_result_rows", f"WITH p AS (SELECT id, raw::JSON AS v FROM {by_page_sql(_rows(RESULTS), "id, raw", "raw")} v), s AS (SELECT id, generate_subscripts(x, 1)::BIGINT - 1 AS pos, unnest(x) AS value FROM (SELECT *, CAST(coalesce(v -> '$.data', v -> '$.results') AS JSON[]) AS x FROM p)), u AS (SELECT id, pos, {SQL_URL('value')}, CASE WHEN json_type(value) <> 'VARCHAR' THEN coalesce(value ->> '$.content', value ->> '$.description', value ->> '$.markdown') END AS description FROM s) SELECT * FROM u WHERE trim(url) <> ''")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.result_rows(_table(spark, sf_dir, RESULTS), ("data", "results"), ("content", "description", "markdown"))


@query("p8_papers", f"WITH p AS (SELECT id AS n, raw::JSON AS v FROM {by_page_sql(_rows(PAPERS), "id, raw", "raw")} v) SELECT n, coalesce(v ->> '$.externalIds.DOI', v ->> '$.paperId', v ->> '$.title') AS id, v ->> '$.title' AS title, (v ->> '$.year')::BIGINT AS year, (v ->> '$.citationCount')::BIGINT AS citations, v ->> '$.externalIds.DOI' AS doi, v ->> '$.externalIds.ArXiv' AS arxiv, CASE WHEN (v -> '$.authors') IS NOT NULL THEN array_to_string(v ->> '$.authors[*].name', '; ') END AS authors, CASE WHEN list_contains(json_keys(v), 'openAccessPdf') THEN json_type((v -> '$.openAccessPdf')) <> 'NULL' END AS open_access, v ->> '$.openAccessPdf.url' AS pdf_url FROM p")
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, PAPERS).select(F.col("id").alias("n"), P.papers(F.col("raw")).alias("p")).select("n", "p.*")


@query("p10_works", f"WITH p AS (SELECT id AS n, raw::JSON AS v FROM {by_page_sql(_rows(WORKS), "id, raw", "raw")} v) SELECT n, v ->> '$.id' AS id, v ->> '$.display_name' AS title, regexp_replace(v ->> '$.doi', '^https://doi.org/', '') AS doi, (v ->> '$.publication_year')::BIGINT AS year, (v ->> '$.cited_by_count')::BIGINT AS citations, coalesce(json_array_length(v -> '$.referenced_works'), 0)::INT AS n_references, (v ->> '$.open_access.is_oa')::BOOLEAN AS open_access FROM p")
def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, WORKS).select(F.col("id").alias("n"), P.works(F.col("raw")).alias("w")).select("n", "w.*")


@query("p11_crossref", f"WITH p AS (SELECT id AS n, raw::JSON AS v FROM {by_page_sql(_rows(CROSS), "id, raw", "raw")} v), a AS (SELECT n, string_agg(trim(concat_ws(' ', x ->> '$.given', x ->> '$.family')), '; ' ORDER BY k) AS authors FROM (SELECT n, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM (SELECT n, CAST(v -> '$.author' AS JSON[]) AS l FROM p)) GROUP BY 1) SELECT n, v ->> '$.DOI' AS doi, v ->> '$.title[0]' AS title, authors, coalesce(v ->> '$.published-print.date-parts[0][0]', v ->> '$.published-online.date-parts[0][0]')::BIGINT AS year, (v ->> '$.is-referenced-by-count')::BIGINT AS citations FROM p LEFT JOIN a USING (n)")
def crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, CROSS).select(F.col("id").alias("n"), P.crossref_works(F.col("raw")).alias("w")).select("n", "w.*")


@query("p14_repositories", f"WITH p AS (SELECT id AS n, raw::JSON AS v FROM {by_page_sql(_rows(REPOS), "id, raw", "raw")} v) SELECT n, v ->> '$.full_name' AS full_name, v ->> '$.description' AS description, (v ->> '$.stargazers_count')::BIGINT AS stars, (v ->> '$.forks_count')::BIGINT AS forks, nullif(v ->> '$.license.spdx_id', 'NOASSERTION') AS license FROM p")
def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, REPOS).select(F.col("id").alias("n"), P.repositories(F.col("raw")).alias("r")).select("n", "r.*")


@query("p15_models", f"WITH p AS (SELECT id AS n, raw::JSON AS v FROM {by_page_sql(_rows(MODELS), "id, raw", "raw")} v) SELECT n, v ->> '$.id' AS id, regexp_extract(v ->> '$.id', '^(.*)/[^/]*$', 1) AS owner, regexp_extract(v ->> '$.id', '([^/]*)$', 1) AS name, array_to_string(list_sort(list_distinct(v ->> '$.tags[*]')), ',') AS tags, (v ->> '$.downloads')::BIGINT AS downloads, (v ->> '$.likes')::BIGINT AS likes FROM p")
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, MODELS).select(F.col("id").alias("n"), P.models(F.col("raw")).alias("m")).select("n", "m.*")


@query("p14_readme", "SELECT page_id AS id, html AS readme FROM pages")
def readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in base64, a line break after each 60 characters."""
    raw = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "([^\\n]{60})", "$1\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), P.decoded_readme(raw).alias("readme"))


ATOM = """<feed><entry><id>http://arxiv.org/abs/1</id><title>One
 two</title><summary> s one </summary><published>2017-06-12T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><category term="cs.CL"/><category term="cs.LG"/></entry><entry><id>2</id><title>Three</title><summary>s</summary><published>2020</published><author><name>C</name></author><category term="cs.DS"/></entry></feed>"""


@query("p16_feed_entries")
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.feed_entries(spark.createDataFrame([(0, ATOM)], "id int, xml string"))


FEEDS = """SELECT page_id AS id, '<feed><entry><id>http://arxiv.org/abs/' || CAST(page_id AS STRING) || '</id><title>One' || chr(10) || ' two ' || CAST(page_id AS STRING) || '</title><summary> s  one </summary><published>' || CAST(2000 + page_id % 20 AS STRING) || '-06-12T00:00:00Z</published><author><name>A</name></author><author><name>B' || CAST(page_id AS STRING) || '</name></author><category term="cs.CL"/><category term="cs.LG"/></entry><entry><id>2</id><title>Three</title><summary>s</summary><published>none</published><author><name>C</name></author><category term="cs.DS"/></entry></feed>' AS xml FROM pages"""


@query(
    "p16_page_feeds",
    "SELECT page_id AS id, 0 AS pos, 'http://arxiv.org/abs/' || page_id AS entry_id, 'One two ' || page_id AS title, 's one' AS summary, (2000 + page_id % 20)::INT AS year, 'A; B' || page_id AS authors, 'cs.CL cs.LG' AS categories FROM pages UNION ALL SELECT page_id, 1, '2', 'Three', 's', NULL, 'C', 'cs.DS' FROM pages",
)
def page_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of two entries for each page."""
    return P.feed_entries(over(spark, sf_dir, FEEDS, "pages"))


STREAMS = [("r1", ['event: x.delta\ndata: {"delta":"He', 'llo"}\n\n', "data: [DONE]\n\n"]), ("r2", ['﻿data: {"choices":[{"delta":{"content":"A"}}]}\r\n\r\ndata: {"choices":[{"delta":{"content":"B"}}]}\r\n\r\n']), ("r3", ['event: x.failed\ndata: {"response":{"error":{"message":"boom"}}}\n\n']), ("r4", ['data: {"type":"x.completed","response":{"output_text":"full"}}\n\n'])]


@query("p20_stream_responses", "SELECT conv_id || '-' || turn AS resp_id, 'done' AS status, text AS content, NULL::VARCHAR AS error FROM conversations UNION ALL SELECT * FROM (VALUES ('r1', 'done', 'Hello', NULL), ('r2', 'incomplete', 'AB', NULL), ('r3', 'failed', '', 'boom'), ('r4', 'completed', 'full', NULL)) v(resp_id, status, content, error)")
def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn streamed as one delta whose bytes are cut anywhere, and literal streams of all endings."""
    rows = [(r, i, bytearray(c.encode())) for r, cs in STREAMS for i, c in enumerate(cs)]
    literal = spark.createDataFrame(rows, "resp_id string, seq int, chunk binary")
    body = F.encode(F.concat(F.lit("data: "), F.to_json(F.struct(F.col("text").alias("delta"))), F.lit("\n\ndata: [DONE]\n\n")), "UTF-8")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("resp_id"), body.alias("body"))
    cuts = F.posexplode(F.sequence(F.lit(1), F.octet_length("body"), F.lit(61))).alias("seq", "at")
    pieces = turns.select("resp_id", "body", cuts).select("resp_id", "seq", F.expr("substring(body, at, 61)").alias("chunk"))
    return P.stream_responses(pieces.unionByName(literal))
