"""Structuring of a long paper by chunks: metadata, views, reports of chunks, accepted edits, strategy keys, reference tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower

# Openings and phrases that no title has; bounds of options; budgets of edits; the digest of a failed chunk.
NO_TITLE = r"^(provided proper attribution|arxiv:|doi:|abstract$|abstract )|permission to reproduce|licensed under|copyright"
TITLE_LINES, TITLE_CHARS, TITLE_WORDS = 80, (8, 180), 24
OPTION_BOUNDS = {"max_chunk_chars": (6500, 1000, 20000), "overlap_chars": (500, 0, 5000), "concurrency": (2, 1, 4), "max_output_tokens": (1600, 256, 4000)}
LEAST_CONFIDENCE, CHUNK_SHARE, TEXT_SHARE = 0.55, 2, 3
FAILED_DIGEST = "LLM chunk failed; use source text anchors for inspection."
REFERENCE_CHARS, REFERENCE_LINES = 25, 120


def option(name: str, value: Column) -> Column:
    """An option within its bounds; its default where there is none."""
    default, low, high = OPTION_BOUNDS[name]
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^#+", ""))


def looks_like_title(line: Column) -> Column:
    bare = _bare(F.trim(line))
    words = F.size(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""))
    return F.char_length(bare).between(*TITLE_CHARS) & ~F.endswith(bare, F.lit(".")) & ~bare.contains("http://") & ~bare.contains("https://") & ~ascii_lower(bare).rlike(NO_TITLE) & (words <= TITLE_WORDS) & bare.rlike(r"\p{IsAlphabetic}")


def infer_metadata(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title, abstract: the first line that looks like a title among the first TITLE_LINES before the heading abstract; the line after that heading.

    By array functions over a document's solid lines: no shuffle.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = docs.select(key, lines.alias("l"))
    heads = F.transform("l", lambda x: ascii_lower(_bare(x)) == "abstract")
    rows = rows.select(key, "l", F.array_position(heads, F.lit(True)).alias("at"), F.array_position(F.slice(heads, F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.lit(True)).alias("before_last"))
    most = F.least(F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.size("l")), F.lit(TITLE_LINES)).cast("int")
    title = F.get(F.filter(F.slice("l", F.lit(1), most), looks_like_title), F.lit(0))
    return rows.select(key, _bare(title).alias("title"), F.when(F.col("before_last") > 0, F.get("l", F.col("before_last").cast("int"))).alias("abstract"))


def view_of(papers: DataFrame, view: str, section_id: str | None = None, with_text: bool = False, most: int | None = None) -> DataFrame:
    """papers (cache_key, sections: array of structs with section_id and clean_text) -> the view: summary (no texts), full, or one section.

    Texts are left out unless asked for, and cut to `most` characters in the whole views.
    """
    if view not in ("summary", "full", "section"):
        raise ValueError("view must be one of summary, full, section")
    if view == "section" and not (section_id or "").strip():
        raise ValueError("section_id is required when view is section")
    shown = with_text and view != "summary"
    text = lambda s: (s["clean_text"] if view == "section" or most is None else F.left(s["clean_text"], F.lit(most))) if shown else F.lit(None).cast("string")
    sections = F.transform("sections", lambda s: F.struct(s["section_id"].alias("section_id"), s["title"].alias("title"), text(s).alias("clean_text")))
    rows = papers.select("cache_key", sections.alias("sections"))
    if view != "section":
        return rows
    return rows.withColumn("section", F.get(F.filter("sections", lambda s: s["section_id"] == section_id), F.lit(0))).where("section is not null").select("cache_key", "section.*")


def chunk_reports(chunk_rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, byte_start, byte_end, line_start, line_end, chunk) with the model's outputs (doc_id, chunk_id, digest, error, repaired, json_valid).

    A chunk whose call failed, or that has no output, gets the fallback: a fixed digest, and the error and its lines as warnings.
    """
    o = outputs.select("doc_id", "chunk_id", F.lit(True).alias("answered"), "digest", "error", "repaired", "json_valid")
    rows = chunk_rows.join(o, ["doc_id", "chunk_id"], "left")
    failed = F.col("answered").isNull() | F.col("error").isNotNull()
    error = F.coalesce("error", F.lit("no output"))
    lines = F.concat(F.lit("line_range="), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    return rows.select(
        "doc_id", "chunk_id", "byte_start", "byte_end", F.char_length("chunk").cast("long").alias("input_chars"),
        F.when(failed, FAILED_DIGEST).otherwise(F.col("digest")).alias("digest"), failed.alias("fallback"),
        (~failed & F.coalesce("json_valid", F.lit(False))).alias("json_valid"), (~failed & F.coalesce("repaired", F.lit(False))).alias("repaired"),
        F.when(failed, F.array(error, lines)).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def report_counters(reports: DataFrame) -> DataFrame:
    """doc_id, calls, retries, invalid_json, fallback_chunks of chunk_reports."""
    return reports.groupBy("doc_id").agg(F.count_if(~F.col("fallback")).alias("calls"), F.count_if("repaired").alias("retries"), F.count_if(~F.col("json_valid")).alias("invalid_json"), F.count_if("fallback").alias("fallback_chunks"))


def patch_counts(docs: DataFrame, chunk_rows: DataFrame, patches: DataFrame) -> DataFrame:
    """doc_id, accepted, rejected: edits are taken as they come while they fit the budgets of their chunk and of the text.

    docs: doc_id, n_bytes; chunk_rows: doc_id, chunk_id, chunk; patches: doc_id, seq, chunk_id, excerpt, confidence (a few a chunk).
    An edit is refused with a confidence below 0.55, with a blank excerpt or one that its chunk does not hold, beyond 2 % of
    the chunk's bytes or beyond 3 % of the text's, and if its chunk is unknown.
    """
    known = patches.join(chunk_rows.select("doc_id", "chunk_id", "chunk"), ["doc_id", "chunk_id"], "left")
    good = F.col("chunk").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= LEAST_CONFIDENCE) & (F.trim("excerpt") != "") & F.col("chunk").contains(F.col("excerpt"))
    rows = known.select("doc_id", F.struct("seq", "chunk_id", F.octet_length("excerpt").alias("n"), F.floor(F.octet_length("chunk") * CHUNK_SHARE / 100).alias("most"), F.coalesce(good, F.lit(False)).alias("good")).alias("p"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).join(docs.select("doc_id", F.floor(F.col("n_bytes") * TEXT_SHARE / 100).alias("budget")), "doc_id")
    start = F.struct(F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("edited"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("by_chunk"))

    def step(a: Column, p: Column) -> Column:
        used = F.coalesce(F.try_element_at(a["by_chunk"], p["chunk_id"]), F.lit(0).cast("long"))
        ok = p["good"] & (used + p["n"] <= p["most"]) & (a["edited"] + p["n"] <= F.col("budget"))
        rest = F.map_filter(a["by_chunk"], lambda k, v: k != p["chunk_id"])
        taken = F.struct((a["accepted"] + 1).alias("accepted"), (a["edited"] + p["n"]).alias("edited"), F.map_concat(rest, F.create_map(p["chunk_id"], used + p["n"])).alias("by_chunk"))
        return F.when(ok, taken).otherwise(a)

    accepted = F.aggregate("ps", start, step)["accepted"]
    return lists.select("doc_id", accepted.alias("accepted"), (F.size("ps") - accepted).alias("rejected"))


def strategy_key(pdf: Column, text: Column, model: Column, profile: Column, prompt: Column, max_chunk: Column, overlap: Column, max_output: Column) -> Column:
    """The cache key of a structuring: a hash of all that its result depends on."""
    pairs = [("pdf", pdf), ("text", text), ("model", model), ("input", profile), ("prompt", prompt), ("chunk", F.lit("paragraph_window")), ("max_chunk", max_chunk), ("overlap", overlap), ("max_output", max_output)]
    return F.sha2(F.concat_ws("\n", F.lit("schema=v1"), F.lit("prompt=v2"), *(F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in pairs)), 256)


def reference_items(tails: DataFrame, offset: int = 0) -> DataFrame:
    """tails (doc_id, tail) -> doc_id, reference_id, text: lines of 25 characters or more, the first 120, numbered from offset."""
    lines = F.filter(F.transform(F.split("tail", r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.char_length(x) >= REFERENCE_CHARS)
    rows = tails.select("doc_id", F.posexplode(F.slice(lines, F.lit(1), F.lit(REFERENCE_LINES))).alias("n", "text"))
    return rows.select("doc_id", F.format_string("ref_%03d", F.col("n") + offset).alias("reference_id"), "text")


def page_anchors(pages: DataFrame, most: int = 48) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, page, line, excerpt of the first solid lines of a page."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "line")).withColumn("excerpt", F.left(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), F.lit(240))).where("excerpt <> ''")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("n"))
    return rows.withColumn("k", place).where(F.col("k") <= most).select("doc_id", "page", (F.col("n") + 1).cast("long").alias("line"), "excerpt")
