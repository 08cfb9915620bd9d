"""URLs as column expressions: hosts, domain filters, routing to source types, materials, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower

# Question sites; page namespaces that are not articles; host -> material kind.
QUESTION_HOSTS = ["stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "mathoverflow.net"]
NAMESPACES = ["special", "talk", "category", "help", "user", "wikipedia", "file", "template", "portal", "draft"]


def host_for_match(url: Column) -> Column:
    """Host in lower case without leading www. (repeated) and trailing dots; a bare domain counts as its host; null if there is none."""
    fixed = F.regexp_replace(F.trim(url), " ", "%20")
    host = F.when(fixed.contains("://"), F.regexp_extract(fixed, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise(F.regexp_extract(fixed, r"^([^/?#:]*)(?:[/?#]|$)", 1))
    return F.nullif(F.regexp_replace(F.lower(host), r"^(www\.)+|\.+$", ""), F.lit(""))


def in_domains(host: Column, domains: Column) -> Column:
    """host equals one of the domains or is below one."""
    return F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def allowed(host: Column, include: Column, exclude: Column) -> Column:
    """The include and exclude filter; a source without host passes if nothing is asked to be included."""
    include, exclude = (F.array_compact(F.transform(x, host_for_match)) for x in (include, exclude))
    return F.when(host.isNull(), F.size(include) == 0).otherwise(((F.size(include) == 0) | in_domains(host, include)) & ~in_domains(host, exclude))


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_remove(F.split(path, "/"), "")


def source_type(url: Column) -> Column:
    """The first extractor that takes the URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    seg = path_segments(url)
    at = lambda i: F.get(seg, F.lit(i))
    number = lambda c: c.rlike(r"^[0-9]{1,19}$")
    question = host.isin(*QUESTION_HOSTS, *(f"meta.{h}" for h in QUESTION_HOSTS)) | F.endswith(host, F.lit(".stackexchange.com"))
    title = F.coalesce(F.try_url_decode(F.replace(at(1), F.lit("+"), F.lit("%2B"))), at(1))
    namespace = F.lower(F.when(title.contains(":"), F.split_part(title, F.lit(":"), F.lit(1))).otherwise(F.lit("")))
    return (
        F.when((host == "github.com") & (F.size(seg) == 4) & (at(2) == "issues") & number(at(3)), "github_issue")
        .when((host == "github.com") & (F.size(seg) == 4) & (at(2) == "pull") & number(at(3)), "github_pr")
        .when((host == "github.com") & (F.size(seg) == 2), "github_repo")
        .when(question & (at(0) == "questions") & number(at(1)), "stack_exchange")
        .when((host == "arxiv.org") & at(0).isin("abs", "pdf") & at(1).isNotNull(), "arxiv")
        .when(F.endswith(host, F.lit(".wikipedia.org")) & (at(0) == "wiki") & at(1).isNotNull() & ~namespace.isin(*NAMESPACES), "wikipedia")
        .otherwise("generic")
    )


def material_kind(url: Column) -> Column:
    u = ascii_lower(url)
    any_of = lambda *x: reduce(lambda a, b: a | b, (u.contains(s) for s in x))
    return (
        F.when(~u.rlike("^https?://"), None)
        .when(any_of("github.com/", "gitlab.com/"), "code")
        .when(any_of("huggingface.co/") & any_of("/datasets/"), "dataset")
        .when(any_of("huggingface.co/") & any_of("/spaces/"), "demo")
        .when(any_of("huggingface.co/"), "model")
        .when(any_of("paperswithcode.com/"), "code")
        .when(any_of("zenodo.org/", "figshare.com/"), "dataset")
        .when(any_of("arxiv.org/src/", "arxiv.org/e-print/"), "supplement")
        .when(any_of("colab.research.google.com/"), "demo")
        .when(any_of("docs.", "/docs", "readthedocs.io/"), "documentation")
        .when(any_of("project", "demo", "dataset", "code"), "project")
    )


def material_confidence(kind: Column) -> Column:
    return F.when(kind.isin("code", "dataset", "model", "demo", "supplement"), "high").when(kind == "documentation", "medium").when(kind.isNotNull(), "low")


def url_tokens(text: Column) -> Column:
    """The http(s) URLs among a text's words, without quotes, brackets and stops around them or slashes behind."""
    words = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.rtrim(F.btrim(w, F.lit("\"'()[]{}<>,.;")), F.lit("/")))
    return F.filter(words, lambda w: w.rlike("^https?://"))


def byte_ranges(length: Column, chunk: int) -> Column:
    """array<struct<first, last>> of a download in chunks."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(chunk).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), (F.least(s + chunk, length) - 1).alias("last")))


#: Schemes whose addresses have a host, and a path of "/" at least.
HOSTED_SCHEMES = ["http", "https", "ws", "wss", "ftp"]


def url_summary(url: Column) -> Column:
    """valid, scheme, host and path of an address; of anything else its length in bytes alone.  Paths are as written, not normalised."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    hosted = scheme.isin(*HOSTED_SCHEMES)
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))
    path = F.regexp_extract(url, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1)
    valid = (scheme != "") & (~hosted | host.isNotNull())
    only = lambda c: F.when(valid, c)
    return F.struct(valid.alias("valid"), only(scheme).alias("scheme"), only(host).alias("host"), only(F.when(hosted & (path == ""), "/").otherwise(path)).alias("path"), F.when(~valid, F.octet_length(url).cast("long")).alias("n_bytes"))


def redact_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^/?#@]+@", "://***@")
