"""Tables, images and pages found in documents: statistics, filter reasons, priorities, Markdown, boxes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the filter and triage rules.
LEAST_IMAGE_PIXELS, LEAST_BOX_AREA, LEAST_BOX = 50_000, 3_000, (60, 40)
LARGE_PIXELS, LARGE_BOX, TINY_PIXELS, TINY_BOX = 20_000, 12_000, 4_096, 2_500
JOIN_GAP = 36.0


def table_stats(rows: Column) -> Column:
    """struct of a table (array of rows of cells): rows, cols (the widest), filled cells, empty ratio, real grid."""
    n = F.array_size(rows)
    cols = F.coalesce(F.array_max(F.transform(rows, lambda r: F.array_size(r))), F.lit(0))
    filled_of = lambda r: F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + filled_of(r))
    cells = F.aggregate(rows, F.lit(0), lambda a, r: a + F.array_size(r))
    rich = F.size(F.filter(rows, lambda r: filled_of(r) >= 2))
    return F.struct(n.alias("rows"), cols.alias("cols"), filled.alias("filled"), F.when(cells == 0, 1.0).otherwise(1 - filled / cells).alias("empty_ratio"), ((n >= 2) & (cols >= 2) & (rich * 2 >= n)).alias("real_grid"))


def table_quality(s: Column) -> Column:
    part = lambda c: F.least(c, F.lit(6)) / 6.0
    return 0.45 * (1 - s["empty_ratio"]) + 0.2 * part(s["rows"]) + 0.2 * part(s["cols"]) + F.when(s["real_grid"], 0.15).otherwise(0.0)


def flows_as_text(s: Column, rows: Column) -> Column:
    """Two columns and eight rows or more, half of which have eight words or more beside four or fewer."""
    words = lambda r, i: F.size(F.filter(F.split(F.coalesce(F.get(r, F.lit(i)), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    prose = F.size(F.filter(rows, lambda r: (words(r, 0) >= 8) & (words(r, 1) <= 4)))
    return (s["cols"] == 2) & (s["rows"] >= 8) & (prose * 2 >= s["rows"])


def table_filter_reason(s: Column, rows: Column) -> Column:
    """Why a table (its statistics, its rows) is not written, null if it is; the first reason that holds."""
    return F.when(s["cols"] < 2, "too_few_columns").when(s["filled"] < 4, "too_few_cells").when(s["rows"] < 2, "single_row").when(s["empty_ratio"] >= 0.5, "sparse").when(~s["real_grid"], "not_real_grid").when(flows_as_text(s, rows), "text_flow_fallback")


def table_markdown(rows: Column) -> Column:
    """The first row as header; pipes and line breaks escaped; short rows padded; ends with a line break; empty without columns."""
    width = F.array_max(F.transform(rows, lambda r: F.array_size(r)))
    escape = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: escape(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    text = F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.array_size(rows) - 1, F.lit(0))), line), F.array(F.lit(""))), "\n")
    return F.when(F.coalesce(width, F.lit(0)) > 0, text).otherwise("")


def image_filter_reason(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    small = box_width.isNotNull() & (box_width * box_height < LEAST_BOX_AREA) & ~((box_width >= LEAST_BOX[0]) & (box_height >= LEAST_BOX[1]))
    return F.when(width * height < LEAST_IMAGE_PIXELS, "tiny_pixel").when(small, "small_bbox")


def image_order(rows: DataFrame, key: list[str]) -> DataFrame:
    """Images numbered from 1: larger box (else pixels) first, then pixels, then index."""
    pixels = F.col("width") * F.col("height")
    area = F.coalesce(F.col("box_width") * F.col("box_height"), pixels)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(area), F.desc(pixels), "image_index")))


def image_signals(rows: DataFrame, key: list[str]) -> DataFrame:
    """Images, large and tiny ones; an image without a box is as large as its pixels."""
    pixels = F.col("width") * F.col("height")
    area = F.coalesce(F.col("box_width") * F.col("box_height"), pixels)
    return rows.groupBy(*key).agg(F.count("*").alias("images"), F.count_if((pixels >= LARGE_PIXELS) | (area >= LARGE_BOX)).alias("large"), F.count_if((pixels < TINY_PIXELS) | (area < TINY_BOX)).alias("tiny"))


def manifest_totals(rows: DataFrame, doc: str, page: str) -> DataFrame:
    """Candidates, written, filtered and failed, by document and by document and page (page null: the whole)."""
    return rows.groupingSets([[F.col(doc)], [F.col(doc), F.col(page)]], F.col(doc), F.col(page)).agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "written").alias("written"), F.count_if(F.col("status") == "filtered").alias("filtered"), F.count_if(F.col("status") == "error").alias("errors"), F.grouping(page).cast("int").alias("whole"))


def union_box(rows: DataFrame, key: list[str]) -> DataFrame:
    """The smallest box around all boxes of a group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return rows.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), right.alias("right"), bottom.alias("bottom"))


def group_boxes(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, image_index, width, height, x, y, w, h) -> doc_id, page, group, members, x, y, right, bottom.

    Parts of a picture: images with a box that the filter rejects, from top to bottom, then from left to right (ties: the
    narrower, then the lower one first).  A box joins the group before it if it is within JOIN_GAP of the group's box so far, so the
    order decides; pages are folded as one sorted stream that holds a single group.  Groups of one are left out.
    """
    rows = rows.where(F.col("x").isNotNull() & image_filter_reason(F.col("width"), F.col("height"), F.col("w"), F.col("h")).isNotNull())
    boxes = rows.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), *(c.cast("double").alias(n) for n, c in (("x", F.col("x")), ("y", F.col("y")), ("right", F.col("x") + F.col("w")), ("bottom", F.col("y") + F.col("h")))))
    placed = boxes.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.asc_nulls_last("y"), "x", "right", "bottom")
    names = ["doc_id", "page", "group", "members", "x", "y", "right", "bottom"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        current, n, members, left, top, right, bottom = None, 0, 0, 0.0, 0.0, 0.0, 0.0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)
            out.clear()
            return made

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page")))
            for key, x, y, r, b in zip(keys, *(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("x", "y", "right", "bottom"))):
                if key == current and x <= right + JOIN_GAP and r >= left - JOIN_GAP and y <= bottom + JOIN_GAP and b >= top - JOIN_GAP:
                    left, top, right, bottom, members = min(left, x), min(top, y), max(right, r), max(bottom, b), members + 1
                    continue
                if members >= 2:
                    n += 1
                    out.append((*current, n, members, left, top, right, bottom))
                if key != current:
                    current, n = key, 0
                left, top, right, bottom, members = x, y, r, b, 1
            yield flush()
        if members >= 2:
            out.append((*current, n + 1, members, left, top, right, bottom))
        yield flush()

    return placed.mapInArrow(fold, "doc_id long, page int, group int, members int, x double, y double, right double, bottom double")


# How far edges and widths of rows of one table may differ, the gap between them, rows that still take another one.
EDGE, WIDTH_DIFFERENCE, ROW_GAP, MOST_ROWS = 18.0, 36.0, (-8.0, 44.0), 32


def merge_single_rows(tables: DataFrame) -> DataFrame:
    """tables (doc_id, page, index, strategy, n_rows, n_cols, x, y, w, h) -> doc_id, page, index (of the first), members, strategy, n_rows, n_cols, x, y, w, h.

    From top to bottom, then from left to right: a table of one row joins the one before it, as that has become, if it has its columns and
    strategy and stands close below (or above).  What a table has become decides, so a page is a fold over its sorted array, in the
    row; it is bounded by what a page holds.  Tables without a box stay alone, behind the others.  At one place the index decides, and
    where an index repeats the other columns, so rows in any order give the same tables.
    """
    place = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("inf")))
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    one = F.struct(place("y").alias("top"), place("x").alias("left"), F.col("index").cast("int").alias("index"), F.array(F.col("index").cast("int")).alias("members"), "strategy", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), *box)
    pages = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("t"))

    def joins(a: Column, b: Column) -> Column:
        gap = F.when(b["y"] >= a["y"], b["y"] - (a["y"] + a["h"])).otherwise(a["y"] - (b["y"] + b["h"]))
        alike = (a["strategy"] == b["strategy"]) & (a["n_cols"] == b["n_cols"]) & (a["n_cols"] >= 2) & (b["n_rows"] == 1) & a["n_rows"].between(1, MOST_ROWS)
        return F.coalesce(alike & (F.abs(a["x"] - b["x"]) <= EDGE) & (F.abs(a["w"] - b["w"]) <= WIDTH_DIFFERENCE) & gap.between(*ROW_GAP), F.lit(False))

    def joined(a: Column, b: Column) -> Column:
        x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
        w, h = F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y
        return F.struct(a["top"].alias("top"), a["left"].alias("left"), a["index"].alias("index"), F.concat(a["members"], b["members"]).alias("members"), a["strategy"].alias("strategy"), (a["n_rows"] + b["n_rows"]).alias("n_rows"), a["n_cols"].alias("n_cols"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(joins(last, b), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined(last, b)))).otherwise(F.concat(done, F.array(b)))

    folded = F.aggregate(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(1), F.lit(1)), step)
    out = pages.select("doc_id", "page", F.explode(folded).alias("m"))
    return out.select("doc_id", "page", *(F.col(f"m.{c}").alias(c) for c in ("index", "members", "strategy", "n_rows", "n_cols", "x", "y", "w", "h")))


def markdown_tables(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, page, block, n_rows, header, body: blocks of pipe rows with a separator row that is not the first.

    Blocks are runs of adjacent pipe rows: a row's number less its rank among the page's pipe rows.
    """
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where(F.trim("line").rlike(r"^\|.*\|$"))
    blocks = rows.withColumn("block", F.col("n") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("n")))
    w = Window.partitionBy("doc_id", "page", "block")
    ruled = blocks.withColumn("separator", F.trim("line").rlike(r"^\|(\s*:?-{2,}:?\s*\|)+$")).withColumn("first", F.min("n").over(w)).withColumn("rule", F.min(F.when(F.col("separator"), F.col("n"))).over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    part = ruled.where((F.col("rule") > F.col("first")) & (F.col("n") != F.col("rule"))).withColumn("cells", F.array_join(cells, " | "))
    join = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "cells")))), lambda s: s["cells"]), "\n")
    return part.groupBy("doc_id", "page", F.col("first").alias("block")).agg((F.count("*") + 1).alias("n_rows"), join(F.col("n") < F.col("rule")).alias("header"), join(F.col("n") > F.col("rule")).alias("body")).where("n_rows >= 3")


# Points and names of the triage rules.
TRIAGE = {
    "figure_caption_without_large_bitmap": 80,
    "table_caption_without_geometry_table": 65,
    "table_geometry_needs_visual_check": 55,
    "fragmented_image_components": 70,
    "many_tiny_image_xobjects": 45,
    "figure_caption_with_bitmap_verify": 25,
    "baseline_table_sample": 1,
    "baseline_figure_sample": 1,
}


def page_priority(p: DataFrame) -> DataFrame:
    """Triage: the sum of the rules that hold for a page's counts, with their names; the last two hold only where nothing else does."""
    captioned, tabled, large, tiny = F.col("figure_captions") > 0, F.col("table_captions") > 0, F.col("large_images") > 0, F.col("tiny_images")
    has_tables = F.col("tables") > 0
    fragmented = (tiny >= 3) & ~large
    holds = [captioned & ~large, tabled & ~has_tables, tabled & has_tables, fragmented, ~fragmented & (tiny >= 5), captioned & large]
    nothing = ~reduce(lambda a, b: a | b, holds)
    holds += [nothing & has_tables, nothing & ~has_tables & (F.col("images") > 0) & captioned]
    rules = list(zip(TRIAGE.items(), holds))
    total = reduce(lambda a, b: a + b, (F.when(cond, points).otherwise(0) for (_, points), cond in rules))
    return p.withColumn("priority", total).withColumn("reasons", F.array_join(F.array_compact(F.array(*(F.when(cond, name) for (name, _), cond in rules))), ","))
