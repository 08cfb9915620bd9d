"""Parsers of captured payloads: JSON answers, result lists, papers, repositories, event streams, feeds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE = r"\[\[\d+\]\]\((https?://[^ \n\t\[<)]*)\)"

PAPER = "title string, abstract string, year long, citationCount long, isOpenAccess boolean, paperId string, authors array<struct<name: string>>, externalIds struct<DOI: string, ArXiv: string>, openAccessPdf struct<url: string>"
WORK = "id string, display_name string, doi string, publication_year long, cited_by_count long, referenced_works array<string>, open_access struct<is_oa: boolean, oa_url: string>"
CROSSREF = "DOI string, title array<string>, author array<struct<given: string, family: string>>, `published-print` struct<`date-parts`: array<array<long>>>, `published-online` struct<`date-parts`: array<array<long>>>, `is-referenced-by-count` long"
REPO = "full_name string, description string, default_branch string, stargazers_count long, forks_count long, license struct<spdx_id: string>"
MODEL = "id string, pipeline_tag string, downloads long, likes long, tags array<string>"


def _present(value: str, first: str, second: str) -> str:
    """first's text if that key is there (even as null), else second's."""
    return f"CASE WHEN array_contains(json_object_keys(to_json({value})), '{first}') THEN try_variant_get({value}, '$.{first}', 'string') ELSE try_variant_get({value}, '$.{second}', 'string') END"


def _source(value: str) -> str:
    url = f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN CAST({value} AS STRING) ELSE {_present(value, 'url', 'uri')} END"
    return f"{url} AS url, CASE WHEN schema_of_variant({value}) <> 'STRING' THEN try_variant_get({value}, '$.title', 'string') END AS title"


def answer_sources(payloads: DataFrame) -> DataFrame:
    """payloads (id, raw) -> id, pos, url, title: an answer's sources, first of each URL, in path order.

    Paths: each output item's action sources, its contents' annotations, their citations; citations of the
    whole answer; links in the text.
    """
    return payloads.sparkSession.sql(
        f"""
WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {{payloads}}),
i AS (SELECT id, i.pos AS a, i.value AS item FROM p, LATERAL variant_explode(try_variant_get(v, '$.output', 'variant')) AS i),
c AS (SELECT id, a, c.pos AS b, c.value AS content FROM i, LATERAL variant_explode(try_variant_get(item, '$.content', 'variant')) AS c),
s AS (
  SELECT id, a, 0 AS path, 0 AS b, s.pos AS n, {_source('s.value')} FROM i, LATERAL variant_explode(try_variant_get(item, '$.action.sources', 'variant')) AS s
  UNION ALL SELECT id, a, 1, b, s.pos, {_source('s.value')} FROM c, LATERAL variant_explode(try_variant_get(content, '$.annotations', 'variant')) AS s
  UNION ALL SELECT id, a, 2, b, s.pos, {_source('s.value')} FROM c, LATERAL variant_explode(try_variant_get(content, '$.citations', 'variant')) AS s
  UNION ALL SELECT id, 1000000, 3, 0, s.pos, {_source('s.value')} FROM p, LATERAL variant_explode(try_variant_get(v, '$.citations', 'variant')) AS s
  UNION ALL SELECT id, 1000000 + a, 4, b, s.pos, s.col, NULL FROM c, LATERAL posexplode(regexp_extract_all(coalesce(try_variant_get(content, '$.text', 'string'), ''), r'{INLINE}', 1)) AS s
), u AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY a, path, b, n) AS k FROM s WHERE trim(url) <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a, path, b, n) - 1 AS BIGINT) AS pos, url, title FROM u WHERE k = 1""",
        payloads=payloads,
    )


def answer_text(payloads: DataFrame) -> DataFrame:
    """id, content: output_text, or the distinct text parts, trimmed, a line each."""
    return payloads.sparkSession.sql(
        """
WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {payloads}),
t AS (SELECT id, i.pos AS a, c.pos AS b, trim(try_variant_get(c.value, '$.text', 'string')) AS x FROM p, LATERAL variant_explode(try_variant_get(v, '$.output', 'variant')) AS i, LATERAL variant_explode(try_variant_get(i.value, '$.content', 'variant')) AS c),
d AS (SELECT id, x, min(struct(a, b)) AS k FROM t WHERE x <> '' GROUP BY id, x),
j AS (SELECT id, array_join(transform(array_sort(collect_list(struct(k, x))), e -> e.x), '\n') AS parts FROM d GROUP BY id)
SELECT p.id, coalesce(nullif(trim(try_variant_get(v, '$.output_text', 'string')), ''), parts, '') AS content FROM p LEFT JOIN j ON p.id = j.id""",
        payloads=payloads,
    )


def result_rows(payloads: DataFrame, keys: tuple[str, ...] = ("results",), description: tuple[str, ...] = ("content", "description")) -> DataFrame:
    """id, pos, url, title, description of a result list: the first of keys that is there; items are strings or objects."""
    lists = ", ".join(f"try_variant_get(v, '$.{k}', 'variant')" for k in keys)
    text = ", ".join(f"try_variant_get(s.value, '$.{d}', 'string')" for d in description)
    return payloads.sparkSession.sql(f"WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {{payloads}}) SELECT id, CAST(s.pos AS BIGINT) AS pos, {_source('s.value')}, CASE WHEN schema_of_variant(s.value) <> 'STRING' THEN coalesce({text}) END AS description FROM p, LATERAL variant_explode(coalesce({lists})) AS s", payloads=payloads).where("trim(url) <> ''")


def papers(raw: Column) -> Column:
    """One literature record: the identifier is DOI, else its own id, else the title; a missing PDF key means open access is unknown."""
    p = F.from_json(raw, PAPER)
    has_key = F.array_contains(F.json_object_keys(raw), "openAccessPdf")
    return F.struct(
        F.coalesce(p["externalIds"]["DOI"], p["paperId"], p["title"]).alias("id"), p["title"].alias("title"), p["year"].alias("year"), p["citationCount"].alias("citations"), p["externalIds"]["DOI"].alias("doi"), p["externalIds"]["ArXiv"].alias("arxiv"),
        F.array_join(F.transform(p["authors"], lambda a: a["name"]), "; ").alias("authors"), F.when(has_key, p["openAccessPdf"].isNotNull()).alias("open_access"), p["openAccessPdf"]["url"].alias("pdf_url"),
    )


def works(raw: Column) -> Column:
    w = F.from_json(raw, WORK)
    return F.struct(w["id"].alias("id"), w["display_name"].alias("title"), F.regexp_replace(w["doi"], "^https://doi.org/", "").alias("doi"), w["publication_year"].alias("year"), w["cited_by_count"].alias("citations"), F.coalesce(F.array_size(w["referenced_works"]), F.lit(0)).alias("n_references"), w["open_access"]["is_oa"].alias("open_access"))


def referenced_works(payloads: DataFrame) -> DataFrame:
    """payloads (id, raw) -> id, pos, work: a work's references, a row each."""
    return payloads.select("id", F.posexplode(F.from_json("raw", WORK)["referenced_works"]).alias("pos", "work"))


def crossref_works(raw: Column) -> Column:
    w = F.from_json(raw, CROSSREF)
    year = lambda f: F.try_element_at(F.try_element_at(w[f]["date-parts"], F.lit(1)), F.lit(1))
    names = F.transform(w["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.struct(w["DOI"].alias("doi"), F.try_element_at(w["title"], F.lit(1)).alias("title"), F.array_join(names, "; ").alias("authors"), F.coalesce(year("published-print"), year("published-online")).alias("year"), w["is-referenced-by-count"].alias("citations"))


def repositories(raw: Column) -> Column:
    r = F.from_json(raw, REPO)
    return F.struct(r["full_name"].alias("full_name"), r["description"].alias("description"), r["stargazers_count"].alias("stars"), r["forks_count"].alias("forks"), F.nullif(r["license"]["spdx_id"], F.lit("NOASSERTION")).alias("license"))


def models(raw: Column) -> Column:
    m = F.from_json(raw, MODEL)
    return F.struct(m["id"].alias("id"), F.regexp_extract(m["id"], "^(.*)/[^/]*$", 1).alias("owner"), F.regexp_extract(m["id"], "([^/]*)$", 1).alias("name"), F.array_join(F.array_sort(F.array_distinct(m["tags"])), ",").alias("tags"), m["downloads"].alias("downloads"), m["likes"].alias("likes"))


def decoded_readme(content: Column) -> Column:
    """Base64 with white space, as text; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.unbase64(F.regexp_replace(content, r"\s", "")).cast("string"))


FEED = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, category: array<struct<_term: string>>>>"


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feeds (id, xml: an Atom feed) -> id, pos, entry_id, title, summary, year, authors, categories."""
    parsed = feeds.select("id", F.posexplode(F.from_xml("xml", FEED)["entry"]).alias("pos", "e"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return parsed.select("id", "pos", F.col("e.id").alias("entry_id"), flat(F.col("e.title")).alias("title"), flat(F.col("e.summary")).alias("summary"), F.left("e.published", F.lit(4)).try_cast("int").alias("year"), F.array_join(F.col("e.author.name"), "; ").alias("authors"), F.array_join(F.col("e.category._term"), " ").alias("categories"))


def _events(body: str) -> Iterator[tuple[str, str]]:
    """(event name, data) of a stream of server-sent events; events end at the first of three kinds of blank line."""
    body = body.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    for block in body.split("\n\n"):
        name, data = "", []
        for line in block.split("\n"):
            field, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "event":
                name = value
            elif field == "data":
                data.append(value)
        if data:
            yield name, "\n".join(data)


def fold_events(body: str) -> tuple[str, str, str | None]:
    """(status, text, error) of one response: deltas are appended until it is done, complete, failed or cut off."""
    parts: list[str] = []
    for name, data in _events(body):
        if data.strip() == "[DONE]":
            return "done", "".join(parts), None
        try:
            value = json.loads(data)
        except ValueError:
            continue
        kind = name or (value.get("type") or "" if isinstance(value, dict) else "")
        if kind.endswith((".failed", ".incomplete")) or kind == "error" or (isinstance(value, dict) and value.get("error")):
            error = value.get("error") or (value.get("response") or {}).get("error") or {}
            return "failed", "".join(parts), str(error.get("message", kind) if isinstance(error, dict) else error)
        if kind.endswith(".completed"):
            final = (value.get("response") or value).get("output_text")
            return "completed", final if final is not None else "".join(parts), None
        delta = value.get("delta") if isinstance(value, dict) else None
        if isinstance(delta, str):
            parts.append(delta)
        for choice in value.get("choices", []) if isinstance(value, dict) else []:
            piece = (choice.get("delta") or {}).get("content")
            if isinstance(piece, str):
                parts.append(piece)
    return "incomplete", "".join(parts), None


def stream_responses(chunks: DataFrame) -> DataFrame:
    """chunks (resp_id, seq, chunk binary) -> resp_id, status, content, error: an ordered fold of each response's bytes.

    Responses are a sorted stream, of which a task holds one at a time.
    """
    placed = chunks.select("resp_id", "seq", "chunk").repartition("resp_id").sortWithinPartitions("resp_id", F.asc_nulls_last("seq"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, current, held, begun = ["resp_id", "status", "content", "error"], None, [], False

        def ended() -> tuple:
            return (current, *fold_events(b"".join(held).decode(errors="replace")))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

        for batch in batches:
            out = []
            for name, chunk in zip(batch.column("resp_id").to_pylist(), batch.column("chunk").to_pylist()):
                if begun and name != current:
                    out.append(ended())
                    held = []
                current, begun = name, True
                held.append(chunk or b"")
            if out:
                yield made(out)
        if begun:
            yield made([ended()])

    return placed.mapInArrow(fold, "resp_id string, status string, content string, error string")
