"""What a vision model says about a page, of whatever JSON types, as rows: objects, completed tables and figures, repairs, warnings.

Models give a number as text, a list as one string, a blank for nothing.  The answer is kept as VARIANT, and each field is read by the type that it
has: text is trimmed and blank text is absent, numbers may be numbers or text, cells may be a list or one string parted by bars.  What
has another type is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower
from lodeworks.functions.variants import as_text, at, has_type, items, number, texts
from lodeworks.operators.vision import box_area, boxes_touch, completed_markdown, expanded_box, flattened_exponent, table_width, valid_box

# Caps of items, cells and texts.
OBJECTS, COMPLETED, REPAIRED, WARNINGS = 3, 4, 1, 3
ROWS, COLUMNS, REPAIR_COLUMNS = 20, 12, 5
PROJECTED_HEADER, PROJECTED_ROWS = 8, 2
SHORT_TEXT, MEDIUM_TEXT = 180, 600

# Kinds of objects, and what models call the states of a completed table or figure and of a repair.
KINDS, RESOURCES = ["figure", "table", "chart", "diagram", "resource", "equation"], ["section", "text", "code", "dataset"]
TABLE_STATES = {"reconstructed": ["reconstructed", "complete", "visible", "usable", "ok"], "partial": ["partial", "fragmented", "missed"], "not_visible": ["not_visible", "not visible", "missing", "not_found"]}
FIGURE_STATES = {"crop_ready": ["crop_ready", "visible", "ready", "usable", "ok"], "fragmented": ["fragmented", "partial", "broken"], "not_visible": ["not_visible", "not visible", "missing", "not_found"]}
REPAIR_STATES = {"ok": ["ok", "found", "present"], "missed": ["missing", "not_found", "missed"]}
#: The repair that a completion's state stands for.
REPAIRS = {"reconstructed": "ok", "crop_ready": "ok", "not_visible": "missed"}
RAW_KEYS = ["page", "label", "caption", "bbox_norm", "caption_bbox_norm", "status", "headers", "rows", "markdown", "confidence", "notes"]

#: How much a figure's and a table's box grows, the least height that is left beside a caption, the gap to it, and the area below which a figure's box is suspect.
FIGURE_PAD, TABLE_PAD, LEAST_HEIGHT, CAPTION_GAP, LEAST_REFINED = (0.015, 0.01), (0.025, 0.015), 0.02, 0.005, 0.004


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_field(v: Column, name: str) -> Column:
    field = at(v, name)
    return F.when(has_type(field, "STRING"), F.nullif(trimmed(as_text(field)), F.lit("")))


def page_field(v: Column, own: Column) -> Column:
    said = F.try_variant_get(v, "$.page", "bigint")
    return F.when(has_type(at(v, "page"), "BIGINT") & (said >= 0), said).otherwise(own)


def strings(v: Column) -> Column:
    """A list's texts as they are; of one text, its parts between bars, trimmed, without blank ones."""
    parts = F.filter(F.transform(F.split(as_text(v), r"\|", -1), trimmed), lambda x: x != "")
    return F.when(has_type(v, "STRING"), parts).otherwise(texts(v))


def cells(v: Column) -> Column:
    """Rows of cells; rows without any are left out."""
    return F.filter(F.transform(F.slice(items(v), F.lit(1), F.lit(ROWS)), lambda r: F.slice(strings(r), F.lit(1), F.lit(COLUMNS))), lambda r: F.size(r) > 0)


def box(v: Column) -> Column:
    return F.filter(F.transform(F.slice(items(v), F.lit(1), F.lit(4)), number), lambda x: x.isNotNull())


def state(v: Column, states: dict[str, list[str]], hyphens: bool = True) -> Column:
    said = ascii_lower(F.coalesce(text_field(v, "status"), F.lit("")))
    said = F.replace(said, F.lit("-"), F.lit("_")) if hyphens else said
    return F.coalesce(*(F.when(said.isin(*names), F.lit(name)) for name, names in states.items()), F.lit("uncertain"))


def page_outputs(outputs: DataFrame) -> DataFrame:
    """outputs (id, page, raw) -> id, page, answer (VARIANT, null if unreadable), status, warnings.

    Text around the outermost braces is ignored; a model's own patches of the text are discarded.
    """
    inner = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    parsed = outputs.select("id", F.col("page").cast("long").alias("page"), F.coalesce(F.try_parse_json("raw"), F.try_parse_json(inner)).alias("answer"))
    patched = F.when(at(F.col("answer"), "patches").isNotNull(), F.lit("discarded_model_text_patches"))
    return parsed.select("id", "page", "answer", F.when(F.col("answer").isNull(), "failed").otherwise("ok").alias("status"), F.array_compact(F.array(patched)).alias("warnings"))


def _listed(outputs: DataFrame, name: str, most: int) -> DataFrame:
    """id, own (page), n, v: the first items of a list of the answer."""
    return outputs.select("id", F.col("page").alias("own"), F.posexplode(F.slice(items(at(F.col("answer"), name)), F.lit(1), F.lit(most))).alias("n", "v"))


V = F.col


def visual_objects(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, n, page, kind, label, summary, confidence."""
    rows = _listed(outputs, "visual_objects", OBJECTS).withColumn("said", F.coalesce(text_field(V("v"), "kind"), F.lit("unknown")))
    low = ascii_lower("said")
    kind = F.when(low.isin(*KINDS), V("said")).when(low.isin(*RESOURCES), "resource").otherwise("unknown")
    return rows.select("id", "n", page_field(V("v"), V("own")).alias("page"), kind.alias("kind"), text_field(V("v"), "label").alias("label"), F.left(text_field(V("v"), "summary"), F.lit(SHORT_TEXT)).alias("summary"), text_field(V("v"), "confidence").alias("confidence"))


def _completed(outputs: DataFrame, name: str, states: dict[str, list[str]]) -> DataFrame:
    v = V("v")
    raw = F.coalesce(F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string, variant>"), lambda k, _: k.isin(*RAW_KEYS))), F.to_json(v))
    return _listed(outputs, name, COMPLETED).select(
        "id", "n", "v", page_field(v, V("own")).alias("page"), text_field(v, "label").alias("label"), F.left(text_field(v, "caption"), F.lit(MEDIUM_TEXT)).alias("caption"), state(v, states).alias("status"),
        box(at(v, "bbox_norm")).alias("box"), number(at(v, "confidence")).alias("confidence"), F.left(text_field(v, "notes"), F.lit(MEDIUM_TEXT)).alias("notes"), raw.alias("raw"),
    )


def figure_completions(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, n, page, label, caption, status, box, caption_box, refined_box, validation, warnings, confidence, notes, raw.

    A figure's box gives way to its caption's where they touch (the edge that faces the caption moves off it), then grows a
    little, but not back over the caption.
    """
    rows = _completed(outputs, "figure_completions", FIGURE_STATES).withColumn("caption_box", box(at(V("v"), "caption_bbox_norm"))).drop("v")
    rows = rows.withColumn("b", valid_box(V("box"))).withColumn("c", valid_box(V("caption_box")))
    side = lambda name, i: F.get(V(name), F.lit(i))
    touch = F.coalesce(boxes_touch(V("b"), V("c")), F.lit(False))
    below, above = touch & (side("c", 1) >= side("b", 1)) & (side("c", 1) <= side("b", 3)), touch & (side("c", 3) >= side("b", 1)) & (side("c", 3) <= side("b", 3))
    rows = rows.withColumn("move", F.when(below, "bottom").when(above, "top"))
    rows = rows.withColumn("bottom", F.when(V("move") == "bottom", F.greatest(side("c", 1) - CAPTION_GAP, side("b", 1) + LEAST_HEIGHT)))
    rows = rows.withColumn("top", F.when(V("move") == "top", F.least(side("c", 3) + CAPTION_GAP, side("b", 3) - LEAST_HEIGHT)))
    rows = rows.withColumn("m", F.array(side("b", 0), F.coalesce("top", side("b", 1)), side("b", 2), F.coalesce("bottom", side("b", 3)))).withColumn("g", expanded_box(V("m"), *FIGURE_PAD))
    grown = F.array(side("g", 0), F.greatest(side("g", 1), F.coalesce("top", F.lit(0.0))), side("g", 2), F.least(side("g", 3), F.coalesce("bottom", F.lit(1.0))))
    seen = (V("status") != "not_visible") & V("b").isNotNull()
    rows = rows.withColumn("refined_box", F.when(seen, grown).otherwise(F.array().cast("array<double>")))
    found = [
        F.when((V("status") != "not_visible") & V("b").isNull(), "invalid_or_missing_figure_bbox"),
        F.when(seen & V("move").isNotNull(), "refined_figure_bbox_removed_caption_overlap"),
        F.when(seen & (box_area(V("refined_box")) < LEAST_REFINED), "refined_figure_bbox_too_small"),
    ]
    rows = rows.withColumn("warnings", F.array_compact(F.array(*found)))
    fine = F.forall("warnings", lambda w: w == "refined_figure_bbox_removed_caption_overlap")
    return rows.withColumn("validation", F.when(fine, "ok").otherwise("warning")).select("id", "n", "page", "label", "caption", "status", "box", "caption_box", "refined_box", "validation", "warnings", "confidence", "notes", "raw")


def table_completions(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, n, page, label, caption, status, headers, rows, markdown, box, refined_box, validation, warnings, confidence, notes, raw."""
    v = V("v")
    rows = _completed(outputs, "table_completions", TABLE_STATES).withColumn("headers", strings(at(v, "headers"))).withColumn("rows", cells(at(v, "rows")))
    said = text_field(v, "markdown")
    rows = rows.withColumn("markdown", F.coalesce(F.when(said.contains("|"), said), completed_markdown(V("headers"), V("rows")))).drop("v")
    rows = rows.withColumn("b", valid_box(V("box"))).withColumn("width", table_width(V("headers"), V("rows")))
    seen = V("status") != "not_visible"
    rows = rows.withColumn("refined_box", F.when(seen & V("b").isNotNull(), expanded_box(V("b"), *TABLE_PAD)).otherwise(F.array().cast("array<double>")))
    found = [
        F.when(seen & V("b").isNull(), "invalid_or_missing_table_bbox"),
        F.when(seen & (F.size("headers") == 0) & (F.size("rows") == 0), "table_completion_has_no_cells"),
        F.when(seen & F.exists("rows", lambda r: F.size(r) != V("width")), "table_row_width_mismatch"),
        F.when(seen & F.exists(F.flatten("rows"), flattened_exponent), "table_values_may_need_superscript_or_exponent_validation"),
    ]
    rows = rows.withColumn("warnings", F.array_compact(F.array(*found)))
    return rows.withColumn("validation", F.when(F.size("warnings") == 0, "ok").otherwise("warning")).select("id", "n", "page", "label", "caption", "status", "headers", "rows", "markdown", "box", "refined_box", "validation", "warnings", "confidence", "notes", "raw")


def _as_repairs(completed: DataFrame, *more: Column) -> DataFrame:
    status = F.coalesce(*(F.when(V("status") == s, F.lit(r)) for s, r in REPAIRS.items()), F.lit("uncertain"))
    return completed.select("id", (V("n") + REPAIRED).alias("n"), "page", "label", status.alias("status"), *more, "notes")


def _said_repairs(outputs: DataFrame, name: str, *more: Column) -> DataFrame:
    v = V("v")
    return _listed(outputs, name, REPAIRED).select("id", "n", page_field(v, V("own")).alias("page"), text_field(v, "label").alias("label"), state(v, REPAIR_STATES, False).alias("status"), *more, F.left(text_field(v, "notes"), F.lit(SHORT_TEXT)).alias("notes"))


def table_repairs(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, n, page, label, status, header, sample_rows, notes: the model's own repair, then one for each completed table."""
    v, cut = V("v"), lambda c, n: F.slice(c, F.lit(1), F.lit(n))
    samples = F.transform(cut(items(at(v, "sample_rows")), 1), lambda r: cut(strings(r), REPAIR_COLUMNS))
    said = _said_repairs(outputs, "table_repairs", cut(strings(at(v, "header")), REPAIR_COLUMNS).alias("header"), samples.alias("sample_rows"))
    return said.unionByName(_as_repairs(table_completions(outputs), cut(V("headers"), PROJECTED_HEADER).alias("header"), cut(V("rows"), PROJECTED_ROWS).alias("sample_rows")))


def figure_repairs(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, n, page, label, status, notes."""
    return _said_repairs(outputs, "figure_repairs").unionByName(_as_repairs(figure_completions(outputs)))


def layout_notes(outputs: DataFrame) -> DataFrame:
    """page_outputs -> id, page, n, note: of the first layout warnings those that are texts, or objects as JSON."""
    rows = _listed(outputs, "layout_warnings", WARNINGS)
    note = F.when(has_type(V("v"), "STRING"), as_text(V("v"))).when(has_type(V("v"), "OBJECT"), F.to_json("v"))
    return rows.select("id", V("own").alias("page"), "n", F.left(note, F.lit(SHORT_TEXT)).alias("note")).where("note is not null")


def merged_document(outputs: DataFrame) -> DataFrame:
    """page_outputs -> doc totals of all pages: id, pages, failed, objects, tables, figures, repairs (with what completions stand for), notes.

    A page's parts are counted in the page's row, so an answer travels nowhere; only counts are added up.
    """
    size = lambda name, most: F.least(F.size(items(at(V("answer"), name))), F.lit(most)).cast("long")
    tables, figures = size("table_completions", COMPLETED), size("figure_completions", COMPLETED)
    repairs = size("table_repairs", REPAIRED) + size("figure_repairs", REPAIRED) + tables + figures
    notes = F.size(F.filter(F.slice(items(at(V("answer"), "layout_warnings")), F.lit(1), F.lit(WARNINGS)), lambda e: has_type(e, "STRING") | has_type(e, "OBJECT"))).cast("long")
    counts = outputs.select("id", (V("status") == "failed").alias("failed"), size("visual_objects", OBJECTS).alias("objects"), tables.alias("tables"), figures.alias("figures"), repairs.alias("repairs"), notes.alias("notes"))
    return counts.groupBy("id").agg(F.count("*").alias("pages"), F.count_if("failed").alias("failed"), *(F.sum(c).alias(c) for c in ("objects", "tables", "figures", "repairs", "notes")))


def completions(outputs: DataFrame, page: Column) -> DataFrame:
    """outputs (id, raw) -> id, kind, n, page, label, caption, status, repair, markdown, confidence, notes of the completed tables and figures."""
    read = page_outputs(outputs.select("id", page.alias("page"), "raw"))
    repair = F.coalesce(*(F.when(V("status") == s, F.lit(r)) for s, r in REPAIRS.items()), F.lit("uncertain"))
    both = (("table", table_completions(read), V("markdown")), ("figure", figure_completions(read), F.lit(None).cast("string")))
    tables, figures = (rows.select("id", F.lit(kind).alias("kind"), "n", "page", "label", "caption", "status", repair.alias("repair"), markdown.alias("markdown"), "confidence", "notes") for kind, rows, markdown in both)
    return tables.unionByName(figures)
