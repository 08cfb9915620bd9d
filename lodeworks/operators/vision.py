"""Pages seen as pictures: captions, written images, boxes, completed tables, page signals and layout warnings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower
from lodeworks.operators.artifacts import LEAST_BOX_AREA, image_filter_reason, markdown_tables, page_priority
from lodeworks.operators.documents import text_signals

# Captions of a page, images of a page, a box's least area, the gap that still touches, a label's length.
CAPTIONS, PAGE_IMAGES, LEAST_AREA, MARGIN = 16, 10, 0.002, 0.015
LABEL = 80


def figure_captions(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, page, n, caption: the first CAPTIONS lines that begin as a figure's caption."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    found = F.filter(lines, lambda x: ascii_lower(x).rlike(r"^(fig\.|figure )"))
    return pages.select("doc_id", "page", F.posexplode(F.slice(found, F.lit(1), F.lit(CAPTIONS))).alias("n", "caption"))


def caption_only_figures(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Captions with the reason why no picture is theirs: images (doc_id, page, status, box_area) may hold a large one on the page."""
    large = images.where((F.col("status") == "written") & (F.coalesce("box_area", F.lit(0.0)) >= LEAST_BOX_AREA)).select("doc_id", "page").distinct().withColumn("large", F.lit(True))
    rows = figure_captions(pages).join(large, ["doc_id", "page"], "left")
    return rows.select("doc_id", "page", "n", "caption", F.when(F.col("large"), "figure_caption_with_unverified_bitmap_match").otherwise("figure_caption_without_written_large_bitmap").alias("reason"))


def written_images(images: DataFrame) -> DataFrame:
    """images (doc_id, page, image_index, width, height, box_width, box_height, sha256) -> with rank, reason, duplicate_of.

    A document's images are decided page by page, larger boxes (else pixels) first: too small; the same bytes as one already
    written; more than PAGE_IMAGES on a page.  Only written images count for the last two, so the order decides and a document is
    one group, bounded by its pages.
    """
    kind = "doc_id long, page int, image_index int, rank int, reason string, duplicate_of string"
    reason = image_filter_reason(*(F.col(c) for c in ("width", "height", "box_width", "box_height")))
    pixels = F.col("width") * F.col("height")
    rows = images.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("image_index").cast("int").alias("image_index"), "sha256", reason.alias("reason"), F.coalesce(F.col("box_width") * F.col("box_height"), pixels).cast("double").alias("area"), pixels.alias("pixels"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        written: dict[str, str] = {}
        out = []
        for page, rest in pdf.sort_values(["page", "area", "pixels", "image_index"], ascending=[True, False, False, True], kind="stable").groupby("page"):
            kept = 0
            for rank, r in enumerate(rest.itertuples(), 1):
                why, same = r.reason, None
                if why is None and r.sha256 in written:
                    why, same = "duplicate", written[r.sha256]
                if why is None and kept >= PAGE_IMAGES:
                    why = "page_limit"
                if why is None:
                    kept += 1
                    written[r.sha256] = f"{page}/{r.image_index}"
                out.append((r.doc_id, page, r.image_index, rank, why, same))
        return pd.DataFrame(out, columns=["doc_id", "page", "image_index", "rank", "reason", "duplicate_of"])

    return rows.groupBy("doc_id").applyInPandas(decide, kind)


def valid_box(box: Column) -> Column:
    """A box (array x0, y0, x1, y1 of shares of the page) if it is one: in range, ordered, of an area worth while; else null."""
    inside = F.forall(box, lambda v: (v >= 0) & (v <= 1) & ~F.isnan(v))
    ordered = (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    return F.when((F.size(box) == 4) & inside & ordered & (box_area(box) >= LEAST_AREA), box)


def box_area(box: Column) -> Column:
    return (F.get(box, F.lit(2)) - F.get(box, F.lit(0))) * (F.get(box, F.lit(3)) - F.get(box, F.lit(1)))


def boxes_touch(a: Column, b: Column) -> Column:
    at = lambda box, i: F.get(box, F.lit(i))
    return (at(a, 2) + MARGIN >= at(b, 0)) & (at(b, 2) + MARGIN >= at(a, 0)) & (at(a, 3) + MARGIN >= at(b, 1)) & (at(b, 3) + MARGIN >= at(a, 1))


def expanded_box(box: Column, x: float, y: float) -> Column:
    at = lambda i: F.get(box, F.lit(i))
    return F.array(F.greatest(at(0) - x, F.lit(0.0)), F.greatest(at(1) - y, F.lit(0.0)), F.least(at(2) + x, F.lit(1.0)), F.least(at(3) + y, F.lit(1.0)))


def table_width(headers: Column, rows: Column) -> Column:
    widest = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.when(F.size(headers) > 0, F.size(headers)).when(widest > 0, widest)


def flattened_exponent(cell: Column) -> Column:
    """A power of ten that has lost its exponent's place."""
    compact = F.replace(cell, F.lit(" "), F.lit(""))
    return compact.contains("×10") & ~compact.contains("^") & ~compact.contains("⁰")


def completed_markdown(headers: Column, rows: Column) -> Column:
    """A completed table in Markdown; missing headers are numbered, rows padded or cut; null without any column."""
    width = table_width(headers, rows)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    places = F.sequence(F.lit(1), width)
    named = F.when(F.size(headers) > 0, headers).otherwise(F.transform(places, lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    body = F.transform(rows, lambda r: line(F.transform(places, lambda i: F.coalesce(F.get(r, i - 1), F.lit("")))))
    return F.when(width.isNotNull(), F.array_join(F.concat(F.array(line(named), line(F.array_repeat(F.lit("---"), width))), body), "\n"))


def safe_label(label: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", ""), F.lit(LABEL))


def artifact_names(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, kind, label, seq, extension) -> with name: a document's artifacts of one page, kind and label are numbered as they come."""
    label = F.coalesce(F.nullif(safe_label(F.col("label")), F.lit("")), F.col("kind"))
    named = rows.withColumn("safe", label)
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "kind", "safe", "extension").orderBy("seq"))
    return named.withColumn("name", F.format_string("llm_refined_p%04d_%s_%02d_%s.%s", F.col("page"), F.col("kind"), n, F.col("safe"), F.col("extension"))).drop("safe")


def page_tables(geometry: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables of pages: geometry (doc_id, page, index, reason: null if usable) and, for pages without a usable one, tables read from the page's text.

    doc_id, page, index (counted on), strategy, reason.
    """
    own = geometry.select("doc_id", "page", "index", F.lit("geometry").alias("strategy"), "reason")
    usable = geometry.where("reason is null").select("doc_id", "page").distinct()
    last = geometry.groupBy("doc_id", "page").agg((F.max("index") + 1).alias("next"))
    read = markdown_tables(pages.join(usable, ["doc_id", "page"], "left_anti")).join(last, ["doc_id", "page"], "left")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block")) - 1
    more = read.select("doc_id", "page", (F.coalesce("next", F.lit(0)) + place).alias("index"), F.lit("markdown").alias("strategy"), F.lit(None).cast("string").alias("reason"))
    return own.unionByName(more)


def page_bundle(pages: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """pages (doc_id, page, text), images (doc_id, page, images, large, tiny), tables (doc_id, page, tables) -> a page's signals with its triage."""
    signals = text_signals(pages.withColumn("place", F.struct("doc_id", "page")), "place").select("place.*", F.col("n_figures").alias("figure_captions"), F.col("n_tables").alias("table_captions"), F.col("n_urls").alias("urls"))
    rows = pages.select("doc_id", "page").join(signals, ["doc_id", "page"], "left").join(images, ["doc_id", "page"], "left").join(tables, ["doc_id", "page"], "left")
    counts = {"figure_captions": "figure_captions", "table_captions": "table_captions", "urls": "urls", "images": "images", "large_images": "large", "tiny_images": "tiny", "tables": "tables"}
    return page_priority(rows.select("doc_id", "page", *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items())))


def layout_warnings(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, spans, chars, lines, images) -> doc_id, warnings: fragmented pages one by one, then counts of blank, image-only and fragmented pages."""
    blank = F.col("chars") == 0
    fragmented = (F.col("chars") > 0) & (F.col("spans") > F.greatest(F.floor(F.col("chars") / 2), F.lit(24)))
    text = F.format_string("page %d has fragmented text layout: spans=%d, chars=%d, lines=%d", "page", "spans", "chars", "lines")
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(fragmented, F.struct("page", text.alias("text"))))).alias("each"), F.count_if(blank).alias("b"), F.count_if(blank & (F.col("images") > 0)).alias("i"), F.count_if(fragmented).alias("f"))
    note = lambda c, says: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(says)))
    notes = F.array_compact(F.array(note("b", " pages have no extracted text chars"), note("i", " pages look image-only; OCR would be required for text"), note("f", " pages have highly fragmented text spans")))
    return g.select("doc_id", F.concat(F.transform("each", lambda e: e["text"]), notes).alias("warnings"))


def text_warnings(signals: DataFrame, least_ratio: float = 0.25) -> DataFrame:
    """signals (doc_id, n_lines, n_repeated, short_ratio) with warnings: a share of short lines from least_ratio on, and repeated lines."""
    short = F.when(F.col("short_ratio") >= least_ratio, F.concat(F.lit("high short-line ratio "), F.format_string("%.2f", F.col("short_ratio"))))
    repeated = F.when(F.col("n_repeated") > 0, F.concat(F.col("n_repeated").cast("string"), F.lit(" repeated layout line candidates")))
    return signals.withColumn("warnings", F.array_compact(F.array(short, repeated)))
