"""Further payload parsers: bibliography hits, extracts, question items, article lists, model output for chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import decode_entities
from lodeworks.functions.variants import at, has_type, items, text, truth

ITEM = "Title string, Url string, VoteUpCount long, CommentCount long, AuthorName string, EditTime long"
# The most sections, entities, patches, anchors and warnings that a chunk's output may have.
CAPS = {"sections": 8, "entities": 16, "patches": 3, "warnings": 8}


def bibliography_hits(payloads: DataFrame) -> DataFrame:
    """payloads (id, raw) -> id, pos, title, year, doi, authors; hits without title are left out; authors may be one or many, objects or names."""
    name = "CASE WHEN schema_of_variant(a) = 'STRING' THEN CAST(a AS STRING) ELSE try_variant_get(a, '$.text', 'string') END"
    return payloads.sparkSession.sql(
        f"""
WITH p AS (SELECT id, try_parse_json(raw) AS v FROM {{payloads}}),
h AS (SELECT id, CAST(h.pos AS BIGINT) AS pos, try_variant_get(h.value, '$.info', 'variant') AS i FROM p, LATERAL variant_explode(try_variant_get(v, '$.result.hits.hit', 'variant')) AS h),
l AS (SELECT id, pos, coalesce(try_variant_get(i, '$.authors.author', 'array<variant>'), array(try_variant_get(i, '$.authors.author', 'variant'))) AS authors, i FROM h)
SELECT id, pos, try_variant_get(i, '$.title', 'string') AS title, try_cast(try_variant_get(i, '$.year', 'string') AS BIGINT) AS year, try_variant_get(i, '$.doi', 'string') AS doi,
  array_join(transform(filter(authors, a -> a IS NOT NULL), a -> {name}), '; ') AS authors
FROM l WHERE try_variant_get(i, '$.title', 'string') IS NOT NULL""",
        payloads=payloads,
    )


def page_extract(raw: Column) -> Column:
    """struct<title, extract> of the first page of an encyclopedia answer; a blank extract is null."""
    pages = F.from_json(F.get_json_object(raw, "$.query.pages"), "map<string, struct<title: string, extract: string>>")
    page = F.try_element_at(F.map_values(pages), F.lit(1))
    return F.struct(page["title"].alias("title"), F.when(F.trim(page["extract"]) != "", page["extract"]).alias("extract"))


def question_items(raw: Column) -> Column:
    """array<struct<title, url, votes, comments>>: missing counts are 0."""
    items = F.from_json(F.get_json_object(raw, "$.Data.Items"), f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in ITEM.split(','))}>>")
    return F.transform(F.coalesce(items, F.array().cast("array<struct<Title: string, Url: string, VoteUpCount: bigint, CommentCount: bigint, AuthorName: string, EditTime: bigint>>")), lambda x: F.struct(x["Title"].alias("title"), x["Url"].alias("url"), F.coalesce(x["VoteUpCount"], F.lit(0)).alias("votes"), F.coalesce(x["CommentCount"], F.lit(0)).alias("comments")))


def answer_code(raw: Column) -> Column:
    """The code of an answer as a whole; -1 if it has none."""
    return F.coalesce(F.get_json_object(raw, "$.Code").try_cast("bigint"), F.lit(-1).cast("bigint"))


COMMENTS = "array<struct<user: struct<login: string>, body: string, created_at: string, submitted_at: string>>"


def comments(payloads: DataFrame, reviews: bool = False) -> DataFrame:
    """payloads (issue_id, raw: a list of comments, or of reviews) -> issue_id, pos, author, body, created_at; reviews are dated by their submission."""
    rows = payloads.select("issue_id", F.posexplode(F.from_json("raw", COMMENTS)).alias("pos", "c"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("issue_id", "pos", text("c.user.login").alias("author"), text("c.body").alias("body"), text("c.submitted_at" if reviews else "c.created_at").alias("created_at"))


def _body(v: Column) -> Column:
    """The Markdown body if that key is there, whatever it holds, else the other one; entities decoded."""
    return decode_entities(F.coalesce(text(F.coalesce(at(v, "body_markdown"), at(v, "body"))), F.lit("")))


def _owner(v: Column) -> Column:
    return decode_entities(F.coalesce(text(at(v, "owner.display_name")), F.lit("")))


def answers(payloads: DataFrame) -> DataFrame:
    """payloads (question_id, raw) -> question_id, pos, accepted, score, author, body, comments (author, body)."""
    parsed = payloads.select("question_id", F.posexplode(items(at(F.try_parse_json("raw"), "items"))).alias("pos", "a"))
    a = F.col("a")
    score = F.when(has_type(at(a, "score"), "BIGINT"), F.try_variant_get(a, "$.score", "bigint"))
    notes = F.transform(items(at(a, "comments")), lambda c: F.struct(_owner(c).alias("author"), _body(c).alias("body")))
    return parsed.select("question_id", "pos", F.coalesce(truth(at(a, "is_accepted")), F.lit(False)).alias("accepted"), F.coalesce(score, F.lit(0)).alias("score"), _owner(a).alias("author"), _body(a).alias("body"), notes.alias("comments"))


def questions(payloads: DataFrame, answer_payloads: DataFrame) -> DataFrame:
    """payloads and answer_payloads (question_id, raw) -> question_id, title, body, answers (in order: accepted, score, as they came).

    A question without any item is no row; answers that are missing or unreadable are none.
    """
    item = at(F.try_parse_json("raw"), "items[0]")
    asked = payloads.select("question_id", item.alias("q")).where("q is not null").select("question_id", decode_entities(F.coalesce(text(at(F.col("q"), "title")), F.lit(""))).alias("title"), _body(F.col("q")).alias("body"))
    order = F.struct((~F.col("accepted")).alias("late"), (-F.col("score")).alias("low"), "pos", "accepted", "score", "author", "body", "comments")
    found = answers(answer_payloads).groupBy("question_id").agg(F.array_sort(F.collect_list(order)).alias("answers"))
    return asked.join(found, "question_id", "left").withColumn("answers", F.coalesce("answers", F.array().cast(found.schema["answers"].dataType)))


class _Articles(HTMLParser):
    """Links within h3 elements, and the p texts after each within the same list item."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[str, str]] = []
        self.inside: list[str] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "a" and "h3" in self.inside:
            self.rows.append({"url": a.get("href") or "", "title": "", "summary": ""})
            self.open = True
        self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag not in ("li", "ul")
        while self.inside and self.inside.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if self.open:
            if "h3" in self.inside and "a" in self.inside:
                self.rows[-1]["title"] += data
            elif "p" in self.inside:
                self.rows[-1]["summary"] += data


def article_lists(pages: DataFrame, base: str) -> DataFrame:
    """pages (page_id, html) -> page_id, pos, url (absolute), title, summary, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Articles()
                parser.feed(html or "")
                for i, r in enumerate(parser.rows):
                    url = r["url"] if "://" in r["url"] else base.rstrip("/") + "/" + r["url"].lstrip("/")
                    out.append((page, i, url, " ".join(r["title"].split()), " ".join(r["summary"].split())))
            yield pd.DataFrame(out, columns=["page_id", "pos", "url", "title", "summary"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, url string, title string, summary string")


def chunk_output(raw: str | None) -> dict:
    """sections, entities and patches of a model's answer for a chunk: fenced or bare JSON, long keys, short keys or tuples; caps and clamps apply."""
    text = raw or ""
    start, end = text.find("{"), text.rfind("}")
    try:
        value = json.loads(text[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return {"valid": False, "sections": [], "entities": [], "patches": []}

    def rows(long: str, short: str, fields: list[tuple[str, str]]) -> list[dict]:
        out = []
        for item in value.get(long, value.get(short)) or []:
            if isinstance(item, list):
                out.append({f: item[i] if i < len(item) else None for i, (f, _) in enumerate(fields)})
            elif isinstance(item, dict):
                out.append({f: item.get(f, item.get(s)) for f, s in fields})
        return out[: CAPS[long]]

    def clamp(x) -> float:
        try:
            return min(1.0, max(0.0, float(x)))
        except (TypeError, ValueError):
            return 0.0

    sections = rows("sections", "s", [("anchor_id", "a"), ("heading", "h"), ("confidence", "c")])
    entities = rows("entities", "e", [("kind", "k"), ("anchor_id", "a"), ("label", "l")])
    patches = rows("patches", "p", [("anchor_id", "a"), ("before", "b"), ("after", "t"), ("confidence", "c")])
    for r in (*sections, *patches):
        r["confidence"] = clamp(r["confidence"])
    return {"valid": True, "sections": sections, "entities": entities, "patches": patches}


OUTPUT = "valid boolean, sections array<struct<anchor_id: string, heading: string, confidence: double>>, entities array<struct<kind: string, anchor_id: string, label: string>>, patches array<struct<anchor_id: string, before: string, after: string, confidence: double>>"


def chunk_outputs(rows: DataFrame) -> DataFrame:
    """rows (chunk_id, raw) -> chunk_id and the parsed output, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [chunk_output(r) for r in pdf["raw"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], **{k: [p[k] for p in parsed] for k in ("valid", "sections", "entities", "patches")}})

    return rows.select("chunk_id", "raw").mapInPandas(run, "chunk_id string, " + OUTPUT)
