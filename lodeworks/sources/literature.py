"""Captured answers of literature services, of every shape: searches, single records, citations and references, as papers.

A capture is one answer: provider, kind (search, get, citations, references), id of what was asked, raw JSON.  Fields are read only if they
have the type that the service promises; where two places may hold a value, the first that is there counts, even as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import clean_html_title, inverted_abstract
from lodeworks.functions.variants import at, has_type, items, text, texts, truth, whole

#: Where each service keeps its list of records; "" is the answer itself.
LISTS = {
    ("semantic", "search"): "data", ("semantic", "citations"): "data", ("semantic", "references"): "data", ("openalex", "search"): "results", ("openalex", "citations"): "results",
    ("crossref", "search"): "message.items", ("dblp", "search"): "result.hits.hit", ("dblp", "get"): "result.hits.hit",
}
SINGLES = {("semantic", "get"): "", ("openalex", "get"): "", ("crossref", "get"): "message"}
RELATED = {("semantic", "citations"): "citingPaper", ("semantic", "references"): "citedPaper", ("dblp", "search"): "info", ("dblp", "get"): "info"}
FIELDS = ["id", "title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "openalex_id", "semantic_id", "url", "pdf_url", "citations", "references", "open_access", "license"]


def _paper(**fields: Column) -> Column:
    none = {"authors": F.array().cast("array<string>"), "year": F.lit(None).cast("long"), "citations": F.lit(None).cast("long"), "references": F.lit(None).cast("long"), "open_access": F.lit(None).cast("boolean")}
    return F.struct(*(fields.get(f, none.get(f, F.lit(None).cast("string"))).alias(f) for f in FIELDS))


def semantic_paper(v: Column) -> Column:
    title, doi, own, pdf = F.coalesce(text(at(v, "title")), F.lit("")), text(at(v, "externalIds.DOI")), text(at(v, "paperId")), text(at(v, "openAccessPdf.url"))
    named = F.filter(F.transform(items(at(v, "authors")), lambda a: text(at(a, "name"))), lambda n: n.isNotNull())
    return _paper(
        id=F.coalesce(doi, own, title), title=title, authors=named, year=whole(at(v, "year")), venue=text(at(v, "venue")), abstract=text(at(v, "abstract")), doi=doi, arxiv_id=text(at(v, "externalIds.ArXiv")), semantic_id=own,
        url=text(at(v, "url")), pdf_url=F.when(F.trim(pdf) != "", pdf), citations=whole(at(v, "citationCount")), references=whole(at(v, "referenceCount")), open_access=F.when(at(v, "openAccessPdf").isNotNull(), ~has_type(at(v, "openAccessPdf"), "VOID")),
    )


def openalex_work(v: Column) -> Column:
    title, own = F.coalesce(text(at(v, "title")), F.lit("")), text(at(v, "id"))
    doi = F.regexp_replace(text(at(v, "doi")), "^(https://doi.org/)+", "")
    named = F.filter(F.transform(items(at(v, "authorships")), lambda a: text(at(a, "author.display_name"))), lambda n: n.isNotNull())
    referenced = at(v, "referenced_works")
    return _paper(
        id=F.coalesce(doi, own, title), title=title, authors=named, year=whole(at(v, "publication_year")), venue=text(at(v, "primary_location.source.display_name")), doi=doi, openalex_id=own, url=own,
        abstract=inverted_abstract(F.try_variant_get(v, "$.abstract_inverted_index", "map<string, array<bigint>>")), pdf_url=text(F.coalesce(at(v, "best_oa_location.pdf_url"), at(v, "primary_location.pdf_url"))),
        citations=whole(at(v, "cited_by_count")), references=F.when(has_type(referenced, "ARRAY"), F.size(items(referenced)).cast("long")), open_access=truth(at(v, "open_access.is_oa")), license=text(at(v, "best_oa_location.license")),
    )


def crossref_work(v: Column) -> Column:
    title, doi = F.coalesce(text(at(v, "title[0]")), F.lit("")), text(at(v, "DOI"))
    part = lambda a, name: F.coalesce(text(at(a, name)), F.lit(""))
    named = F.filter(F.transform(items(at(v, "author")), lambda a: F.trim(F.concat_ws(" ", part(a, "given"), part(a, "family")))), lambda n: n != "")
    year = F.coalesce(F.try_variant_get(v, '$["published-print"]["date-parts"][0][0]', "variant"), F.try_variant_get(v, '$["published-online"]["date-parts"][0][0]', "variant"))
    return _paper(
        id=F.coalesce(doi, title), title=title, authors=named, year=whole(year), venue=text(F.try_variant_get(v, '$["container-title"][0]', "variant")), abstract=text(at(v, "abstract")), doi=doi, url=text(at(v, "URL")),
        references=whole(F.try_variant_get(v, '$["reference-count"]', "variant")), license=text(at(v, "license[0].URL")),
    )


def dblp_hit(v: Column) -> Column:
    title, doi, url, listed = text(at(v, "title")), text(at(v, "doi")), text(at(v, "url")), at(v, "authors.author")
    one = lambda a: text(F.coalesce(at(a, "text"), a))
    many = F.filter(F.transform(items(listed), one), lambda n: n.isNotNull())
    named = F.when(has_type(listed, "ARRAY"), many).otherwise(F.array_compact(F.array(one(listed))))
    return _paper(id=F.coalesce(doi, url, title), title=clean_html_title(title), authors=named, year=F.when(text(at(v, "year")).rlike(r"^\+?\d+$"), text(at(v, "year")).try_cast("long")), venue=text(at(v, "venue")), doi=doi, url=url)


PARSERS = {"semantic": semantic_paper, "openalex": openalex_work, "crossref": crossref_work, "dblp": dblp_hit}


def _by_shape(shapes: dict[tuple[str, str], str], value) -> Column:
    """value(path) of the capture's provider and kind; null for others."""
    return F.coalesce(*(F.when((F.col("provider") == p) & (F.col("kind") == k), value(path)) for (p, k), path in shapes.items()))


def paper_records(captures: DataFrame) -> DataFrame:
    """captures (provider, kind, id, raw) -> provider, kind, id, pos and the paper's fields, a row for each record; unreadable answers give none.

    A single record that is asked for gives one row at most; a service without records gives none; untitled records of a catalogue of titles do not count.
    """
    answers = captures.select("provider", "kind", "id", F.try_parse_json("raw").alias("v"))
    one = F.array(_by_shape(SINGLES, lambda path: at(F.col("v"), path)))
    listed = F.coalesce(_by_shape(LISTS, lambda path: items(at(F.col("v"), path))), F.filter(one, lambda x: x.isNotNull()))
    rows = answers.select("provider", "kind", "id", F.posexplode(listed).alias("pos", "item"))
    rows = rows.withColumn("item", F.coalesce(_by_shape(RELATED, lambda name: F.struct(at(F.col("item"), name).alias("x"))), F.struct(F.col("item").alias("x")))["x"]).where("item is not null")
    rows = rows.where((F.col("provider") != "dblp") | text(at(F.col("item"), "title")).isNotNull())
    parsed = F.coalesce(*(F.when(F.col("provider") == p, f(F.col("item"))) for p, f in PARSERS.items()))
    found = rows.select("provider", "kind", "id", "pos", parsed.alias("p")).select("provider", "kind", "id", "pos", *(F.col(f"p.{f}").alias("paper_id" if f == "id" else f) for f in FIELDS))
    first = (F.col("provider") != "dblp") | (F.col("kind") != "get") | (F.col("pos") == 0)
    return found.where(first)


def referenced_records(captures: DataFrame, limit: int = 50) -> DataFrame:
    """captures of single catalogue works -> provider, id, pos, url: the works that they refer to, in order, `limit` each."""
    works = captures.where((F.col("provider") == "openalex") & (F.col("kind") == "get")).select("provider", "id", F.try_parse_json("raw").alias("v"))
    return works.select("provider", "id", F.posexplode(F.slice(texts(at(F.col("v"), "referenced_works")), F.lit(1), F.lit(limit))).alias("pos", "url"))
