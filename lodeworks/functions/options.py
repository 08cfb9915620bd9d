"""Options, keys and small validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower

# Modes, orders, sources and their other names, hosts that are read in ranges first.
SEARCH_MODES, ORDERS = ["balanced", "broad", "precise"], ["relevance", "citations", "date"]
DEFAULT_SOURCES, ALL_SOURCES = ["dblp", "semantic", "arxiv"], ["dblp", "semantic", "arxiv", "openalex", "crossref"]
ALIASES = {"semantic_scholar": "semantic", "semanticscholar": "semantic", "s2": "semantic"}
RANGE_FIRST_HOSTS = ["arxiv.org", "export.arxiv.org", "openaccess.thecvf.com", "aclanthology.org"]


def one_of(value: Column, names: list[str]) -> Column:
    """The named value, the first name for none or a blank one, null for any other."""
    name = ascii_lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(name == "", names[0]).when(name.isin(*names), name)


def selected_sources(asked: Column, mode: Column) -> Column:
    """The asked sources (array of names, also lists with commas) under their own names; without any, those of the mode; null if one is unknown."""
    parts = F.filter(F.transform(F.flatten(F.transform(asked, lambda s: F.split(s, ","))), lambda s: ascii_lower(F.trim(s))), lambda s: s != "")
    named = F.transform(parts, lambda s: F.coalesce(*(F.when(s == a, n) for a, n in ALIASES.items()), s))
    known = F.forall(named, lambda s: s.isin(*ALL_SOURCES))
    defaults = F.when(mode == "broad", F.array(*map(F.lit, ALL_SOURCES))).otherwise(F.array(*map(F.lit, DEFAULT_SOURCES)))
    return F.when(F.size(asked) == 0, defaults).when(known, named)


def session_key(query: Column) -> Column:
    """Twelve hexadecimal digits that stand for a query."""
    return F.left(F.sha2(query, 256), F.lit(12))


def exactly_one(*values: Column) -> Column:
    """Whether exactly one locator is given and not blank."""
    return sum((F.when(F.trim(F.coalesce(v, F.lit(""))) != "", 1).otherwise(0) for v in values), F.lit(0)) == 1


def pdf_problem(content: Column, most: int) -> Column:
    """Why bytes are no document to read: too many, or no PDF; else null."""
    size = F.octet_length(content)
    too_large = F.concat(F.lit("academic pdf exceeds max size: "), size.cast("string"), F.lit(f" > {most}"))
    return F.when(size > most, too_large).when(F.hex(F.substring(content, 1, 4)) != "25504446", "resolved academic full text is not a PDF")


def absolute_url(raw: Column, base: str) -> Column:
    """Addresses without a scheme or host, below a base."""
    return F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(base), raw)).otherwise(raw)


def article_key(url: Column, list_url: Column, source: Column, date: Column, title: Column) -> Column:
    """What tells articles apart: their address, else that in the list, else source, date and title."""
    solid = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(solid(url), solid(list_url), F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(date, F.lit("")), F.coalesce(title, F.lit(""))))


def download_order(host: Column, direct: Column) -> Column:
    """Strategies in order: ranges first for some hosts; direct ones behind if they are allowed."""
    h = F.lower(host)
    ranged = F.exists(F.array(*map(F.lit, RANGE_FIRST_HOSTS)), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x)))
    own = F.when(ranged, F.array(F.lit("current_range_parallel"), F.lit("current_full"))).otherwise(F.array(F.lit("current_full"), F.lit("current_range_parallel")))
    return F.when(direct, F.concat(own, F.array(F.lit("direct_range_parallel"), F.lit("direct_full")))).otherwise(own)


def range_problem(value: Column, low: int, high: int, name: str) -> Column:
    """Why a number is refused; null if it is in its range, or not given."""
    return F.when(~value.between(low, high), F.lit(f"{name} must be between {low} and {high}"))


def mapped_urls(urls: Column, limit: Column) -> Column:
    """A site map's addresses, no more than asked for, whatever the service sent; blank ones do not count."""
    return F.slice(F.filter(urls, lambda u: F.trim(u) != ""), F.lit(1), F.greatest(limit, F.lit(0)).cast("int"))


def structuring_input(source: Column, source_sha256: Column, content: Column) -> Column:
    """What is structured, and its hash: the source text with its own hash if there is one, else the content with a hash of it."""
    there = source.isNotNull()
    return F.struct(F.when(there, source).otherwise(content).alias("text"), F.when(there, source_sha256).otherwise(F.sha2(F.encode(content, "UTF-8"), 256)).alias("sha256"))
