"""Scholarly identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower

#: A fixed form: four digits, a dot and four bytes or more.
ARXIV_SHAPE = r"^[0-9]{4}\.[^.]{4,}(\..*)?$"


def classify_identifier(raw: Column) -> Column:
    """struct<kind, value>: doi, arxiv, openalex, dblp, url, semantic or query; the first rule that fits.

    Only a DOI may stand behind doi:, everything else in front of a colon is a URL's scheme; an arXiv URL's path
    begins with /abs/ or /pdf/.
    """
    text = F.trim(raw)
    bare = F.trim(F.regexp_replace(text, r"^(?i)doi:", ""))
    under = F.regexp_replace(F.trim(F.regexp_extract(bare, r"^10\.48550/(?:arXiv|arxiv)\.(.*)$", 1)), r"(\.pdf)+$", "")
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:abs|pdf)/([^?#]*)"
    is_url = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~text.rlike(r"^(?i)https?:/*$")
    make = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(under.rlike(ARXIV_SHAPE), make("arxiv", under))
        .when(bare.startswith("10."), make("doi", bare))
        .when(is_url & F.endswith(host, F.lit("arxiv.org")) & text.rlike(path), make("arxiv", F.regexp_replace(F.regexp_extract(text, path, 1), r"\.pdf$", "")))
        .when(is_url & F.endswith(host, F.lit("openalex.org")), make("openalex", text))
        .when(is_url & F.endswith(host, F.lit("dblp.org")), make("dblp", text))
        .when(is_url, make("url", text))
        .when(F.regexp_replace(text, r"\.pdf$", "").rlike(ARXIV_SHAPE), make("arxiv", text))
        .when(text.rlike("^W[0-9]*$"), make("openalex", text))
        .when(text.rlike("^[0-9A-Fa-f]{32,}$"), make("semantic", text))
        .otherwise(make("query", text))
    )


def paper_key(doi: Column, arxiv: Column, semantic: Column, openalex: Column, title: Column, year: Column) -> Column:
    """The strongest identifier, else normalised title and year."""
    key = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), ascii_lower(c)))
    return F.coalesce(key("doi", doi), key("arxiv", arxiv), key("semantic", semantic), key("openalex", openalex), F.concat(F.lit("title:"), title, F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))


def arxiv_pdf_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace(identifier, r"\.pdf$", ""), F.lit(".pdf"))


def compatible_years(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= 2)
