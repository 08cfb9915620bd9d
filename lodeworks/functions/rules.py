"""Small rules as column expressions: URL policy, sites, locators, backoff, labels, rendering of short pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.urls import host_for_match, path_segments

# Sites of question hosts; delays in milliseconds before each attempt from 0 on, the last for all later ones.
SITES = {"stackoverflow.com": "stackoverflow", "serverfault.com": "serverfault", "superuser.com": "superuser", "askubuntu.com": "askubuntu", "mathoverflow.net": "mathoverflow.net"}
DELAYS = {"pdf": [600, 600, 1200, 2400], "llm": [600, 600, 1200, 2400, 4800, 9600], "openalex": [1000, 3000]}
#: Delays that grow by a step for each attempt (first, step).
GROWING = {"semantic": (2500, 2500), "arxiv": (3000, 3000)}


def is_public_url(url: Column) -> Column:
    """http(s) with a host that is no private, loopback, link-local, multicast or unspecified address; names other than localhost pass (they need a lookup)."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"\.+$", "")
    octet = lambda i: F.split_part(host, F.lit("."), F.lit(i)).try_cast("int")
    v4 = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    a, b = octet(1), octet(2)
    private = (a == 10) | (a == 127) | (a == 0) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    v6 = host.startswith("[")
    closed = host.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*|ff.*)\]$")
    return F.when(host == "", False).when(v4, ~private).when(v6, ~closed).otherwise((host != "localhost") & ~F.endswith(host, F.lit(".localhost")))


def bypasses_proxy(host: Column, entries: Column) -> Column:
    """* for all, .domain or *.domain for names below it, else the name itself or one below it."""
    bare = F.transform(entries, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^\*?\.", ""))
    return F.array_contains(entries, "*") | F.exists(bare, lambda e: (e != "") & ((host == e) | F.endswith(host, F.concat(F.lit("."), e))))


def question_site(host: Column) -> Column:
    base = F.regexp_replace(host, r"^meta\.", "")
    named = F.coalesce(*(F.when(base == h, s) for h, s in SITES.items()), F.when(F.endswith(base, F.lit(".stackexchange.com")), F.regexp_replace(base, r"\.stackexchange\.com$", "")))
    return F.when(host == "meta.stackexchange.com", "meta.stackexchange").when(host.startswith("meta."), F.concat(F.lit("meta."), named)).otherwise(named)


def wiki_language(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"^([a-z-]+)\.(?:m\.)?wikipedia\.org$", 1), F.lit(""))


def repository(url: Column) -> Column:
    """struct<provider, kind, name> of a repository's URL."""
    host, seg = host_for_match(url), path_segments(url)
    two = lambda i: F.concat_ws("/", F.get(seg, F.lit(i)), F.get(seg, F.lit(i + 1)))
    make = lambda p, k, n: F.struct(F.lit(p).alias("provider"), F.lit(k).alias("kind"), n.alias("name"))
    return (
        F.when((host == "github.com") & (F.size(seg) >= 2), make("github", "repository", F.regexp_replace(two(0), r"\.git$", "")))
        .when((host == "huggingface.co") & F.get(seg, F.lit(0)).isin("datasets") & (F.size(seg) >= 3), make("huggingface", "dataset", two(1)))
        .when((host == "huggingface.co") & F.get(seg, F.lit(0)).isin("spaces") & (F.size(seg) >= 3), make("huggingface", "space", two(1)))
        .when((host == "huggingface.co") & (F.size(seg) >= 2), make("huggingface", "model", two(0)))
    )


def versioned_base(url: Column) -> Column:
    """A base URL that ends in /v1, without slashes behind or a call's path."""
    bare = F.regexp_replace(F.rtrim(F.trim(url), F.lit("/")), r"/(chat/completions|responses)$", "")
    return F.when(F.endswith(bare, F.lit("/v1")), bare).otherwise(F.concat(bare, F.lit("/v1")))


def backoff_ms(service: Column, attempt: Column) -> Column:
    """The wait before an attempt (from 0) of a service: by its table, or growing by a step."""
    n = F.greatest(attempt, F.lit(0))
    tables = F.coalesce(*(F.when(service == s, F.element_at(F.array(*map(F.lit, d)), F.least(n + 1, F.lit(len(d))).cast("int"))) for s, d in DELAYS.items()))
    return F.coalesce(tables, *(F.when(service == s, (F.lit(first) + F.lit(step) * n).cast("int")) for s, (first, step) in GROWING.items()))


def best_identifier(doi: Column, arxiv: Column, semantic: Column, openalex: Column, title: Column) -> Column:
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("kind"), c.alias("value"))) for n, c in (("doi", doi), ("arxiv", arxiv), ("semantic", semantic), ("openalex", openalex), ("query", title))))


def citation_identifiers(doi: Column, arxiv: Column, semantic: Column, openalex: Column) -> Column:
    pairs = (("semantic", semantic), ("openalex", openalex), ("doi", doi), ("arxiv", arxiv))
    return F.array_join(F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(n + ":"), c)) for n, c in pairs))), " ")


def publisher_pdf(url: Column) -> Column:
    """The PDF of an article page of two publishers, by its number or DOI; null for others."""
    number = F.nullif(F.regexp_extract(url, r"ieeexplore\.ieee\.org/(?:abstract/)?document/([0-9]+)", 1), F.lit(""))
    number = F.coalesce(number, F.nullif(F.regexp_extract(url, r"ieeexplore\.ieee\.org/.*[?&]arnumber=([0-9]+)", 1), F.lit("")))
    doi = F.nullif(F.regexp_extract(url, r"dl\.acm\.org/doi/(?:abs/|full/|pdf/)?(10\.[0-9]+/[^?#]+)", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber="), number), F.concat(F.lit("https://dl.acm.org/doi/pdf/"), doi))


def tolerant_number(text: Column) -> Column:
    """A count from text such as 1,234; 0 if there is none."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", "").try_cast("bigint"), F.lit(0).cast("bigint"))
