"""The fetch path of a page and the assembly of answers that fall back to sources: reasons, labels, slices, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import truncate
from lodeworks.operators.structure import first_available

# Labels of providers by path and origin, pseudo-providers of references.
ENRICHMENT_LABELS = {"primary": "tavily_enrichment", "fallback": "firecrawl_enrichment", "none": "tavily_enrichment"}
FALLBACK_LABELS = {"primary": "tavily_fallback", "fallback": "firecrawl_enrichment", "none": "tavily_fallback"}
REFERENCE_PROVIDER = "openalex_reference"
#: Messages in place of an answer.
EMPTY_ANSWER = "No answer by {provider} could be checked. A second search found {n} source(s), listed for your own reading."
UNVERIFIED_ANSWER = "An answer by {provider} names no source and is left out. A second search found {n} source(s), listed for your own reading."


def resolve_reason(kind: Column, content: Column, error: Column) -> Column:
    """Why a specialist's page is not used: null if it is, or if none matches (kind generic)."""
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    return F.when(kind == "generic", None).when(error.isNotNull(), F.concat(kind, F.lit(" "), error)).when(blank, F.concat(kind, F.lit(" empty render")))


def fetched_pages(pages: DataFrame, limit: int | None) -> DataFrame:
    """pages (page_id, url, kind, special, error, primary, fallback) -> page_id, content, source_type, fallback_reason, original_length, truncated, failed.

    The specialist's rendering if there is one; else the generic providers, the second where the first is blank, with the reason
    of a specialist that failed; failed where all are blank.
    """
    reason = resolve_reason(F.col("kind"), F.col("special"), F.col("error"))
    special = (F.col("kind") != "generic") & reason.isNull()
    content = F.when(special, F.col("special")).otherwise(first_available(F.col("primary"), F.col("fallback")))
    rows = pages.select("page_id", content.alias("whole"), F.when(special, F.col("kind")).otherwise("generic").alias("source_type"), reason.alias("fallback_reason"))
    cut = truncate(F.col("whole"), limit if limit is not None else (1 << 31) - 1)
    return rows.withColumn("cut", cut).select("page_id", "cut.content", "source_type", "fallback_reason", "cut.original_length", "cut.truncated", F.col("whole").isNull().alias("failed"))


def provider_label(path: Column, origin: Column) -> Column:
    """The label that sources get: by path (enrichment or fallback) and where they came from."""
    by = lambda labels: F.coalesce(*(F.when(origin == o, name) for o, name in labels.items()))
    return F.when(path == "enrichment", by(ENRICHMENT_LABELS)).otherwise(by(FALLBACK_LABELS))


def sliced(fetched: DataFrame, extra: int, fallback: int) -> DataFrame:
    """fetched (session_id, pos, ...) of one request for the larger number -> with path: both slices begin at the first source."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    rows = fetched.withColumn("n", place).where(F.col("n") <= max(extra, fallback))
    paths = F.array_compact(F.array(F.when(F.col("n") <= extra, "enrichment"), F.when(F.col("n") <= fallback, "fallback")))
    return rows.withColumn("path", F.explode(paths)).drop("n")


def fallback_message(answer: Column, n_sources: Column, provider: str = "the answer provider") -> Column:
    fill = lambda template: F.concat(F.lit(template.split("{n}")[0].replace("{provider}", provider)), n_sources.cast("string"), F.lit(template.split("{n}")[1]))
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", fill(EMPTY_ANSWER)).otherwise(fill(UNVERIFIED_ANSWER))


def without_reference_sources(sources: Column) -> Column:
    """Sources (array of structs with provider) without those that only stand for a reference."""
    return F.filter(sources, lambda s: s["provider"] != REFERENCE_PROVIDER)
