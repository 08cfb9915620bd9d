"""Registered queries of page outputs: for every page an answer of a vision model, whose types vary with the page's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import vision_output as O
from lodeworks.plans.registry import query
from lodeworks.plans.templates import filled, pick
from lodeworks.sources.tables import table

N = "page_id"


def _pick(*values: str, step: int = 1) -> str:
    return pick(N, *values, step=step)


def _share(low: int, times: int, span: int) -> str:
    """SQL: a number between 0.low and 0.(low + span - 1) hundredths, as JSON text."""
    return f"'0.' || lpad(CAST({low} + {N} * {times} % {span} AS STRING), 2, '0')"


# The answers as one SQL expression that both engines read.
def _object(k: int) -> str:
    return filled(
        '{"page":@page@,"kind":@kind@,"label":@label@,"summary":"@summary@","confidence":@confidence@}',
        page=_pick("3", "2.5", '"4"', "null", "-1", step=k), kind=_pick('" Figure "', '"code"', '"TABLE"', "7", '"odd"', '""', '"dataset"', step=k), label=_pick(f'" L{k} "', '"  "', "5", step=k),
        summary=f"repeat('é', CAST(150 + {N} % 60 AS INT))", confidence=_pick('"high"', "0.5", '" "', step=k),
    )


def _table(k: int) -> str:
    return filled(
        '{"page":@page@,"label":"T@n@","status":@status@,"headers":@headers@,"rows":@rows@,"markdown":@markdown@,"confidence":@confidence@,"bbox_norm":[@x@,"@y@",@x1@,@y1@]}',
        page=_pick("9", "null", '"1"', step=k), n=f"CAST({N} AS STRING)", status=_pick('"Complete"', '"not-visible"', '"partial"', '" OK "', "1", '"not visible"', step=k),
        headers=_pick('["a","b"]', '"a | b ||  c "', "[]", '["x",5,null]', "null", step=k), rows=_pick('[["1","2"],["3"],[],[4]]', '["p | q","r"]', "[]", '[["2×10 5","y"]]', '"no"', '[["a","b","c","d","e","f","g","h","i","j","k","l","m"]]', step=k),
        markdown=_pick("null", '"no bars"', '"| x |"', step=k), confidence=_pick('"0.9"', "0.25", '" 0.5"', "1", '"x"', "null", step=k),
        x=_share(2, 3, 30), y=_share(1, 5, 30), x1=_share(40, 7, 50), y1=_pick("0.75", '"1.5"', "null", '"0.5"', step=k),
    )


def _figure(k: int) -> str:
    return filled(
        '{"label":"F@n@","status":@status@,"caption":"@caption@","confidence":@confidence@,"bbox_norm":[@x@,@y@,@x1@,@y1@],"caption_bbox_norm":[0.1,@c@,0.9,"@c1@"],"note":1}',
        n=f"CAST({N} % 5 AS STRING)", status=_pick('"READY"', '"broken"', "null", '"missing"', '"crop-ready"', step=k), caption=f"repeat('c', CAST(590 + {N} % 20 AS INT))", confidence=_pick("1", '"0.125"', "true", step=k),
        x=_share(1, 3, 20), y=_share(10, 7 + k, 40), x1=_share(22, 11, 60), y1=_share(51, 13, 45), c=_share(5, 17 + k, 80), c1=_share(12, 19 + k, 85),
    )


ANSWER = f"""CASE WHEN {N} % 17 = 0 THEN 'no object' WHEN {N} % 19 = 0 THEN '{{"visual_objects":[' ELSE """ + filled(
    '@before@{@patches@"visual_objects":@objects@,"table_completions":[@t1@,@t2@],"figure_completions":[@f1@,@f2@,@f3@,@f4@,@f5@],"table_repairs":[{"label":"R","status":@status@,"header":"h1|h2","sample_rows":[["s"],["t"]],"notes":"n"},{"label":"second"}],"figure_repairs":@repairs@,"layout_warnings":[@notes@]}@after@',
    before=_pick("", "Here it is: "), patches=_pick("", '"patches":[],', '"patches":null,'), objects=f"CASE WHEN {N} % 7 = 0 THEN 'null' ELSE " + filled("[@a@,@b@,5,@c@]", a=_object(1), b=_object(2), c=_object(3)) + " END",
    t1=_table(1), t2=_table(2), **{f"f{k}": _figure(k) for k in range(1, 6)}, status=_pick('"Found"', '"missed"', '"partial"', '"OK"', "null"), repairs=_pick('{"label":"no list"}', '[{"status":"present","page":8}]', "[]"),
    notes=_pick('"w1",2,"w3","w4"', '{"a":1},"x"', "null"), after=_pick("", " done"),
) + " END"

# The same rules in DuckDB.
_text = lambda x, k: f"CASE WHEN json_type({x}, '$.{k}') = 'VARCHAR' THEN nullif(trim({x} ->> '$.{k}'), '') END"
_number = lambda e: f"CASE WHEN json_type({e}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({e} AS DOUBLE) WHEN json_type({e}) = 'VARCHAR' AND regexp_matches({e} ->> '$', '^[0-9.]+$') THEN CAST({e} ->> '$' AS DOUBLE) END"
_items = lambda e: f"CASE WHEN json_type({e}) = 'ARRAY' THEN CAST({e} AS JSON[]) ELSE [] END"
_strings = lambda e, v="e": f"CASE WHEN json_type({e}) = 'VARCHAR' THEN list_filter(list_transform(string_split({e} ->> '$', '|'), lambda {v}: trim({v})), lambda {v}: {v} <> '') ELSE list_transform(list_filter({_items(e)}, lambda {v}: json_type({v}) = 'VARCHAR'), lambda {v}: {v} ->> '$') END"
_page = lambda x: f"CASE WHEN json_type({x}, '$.page') = 'UBIGINT' THEN CAST({x} ->> '$.page' AS BIGINT) ELSE own END"
_box = lambda e: f"list_filter(list_transform(({_items(e)})[1:4], lambda b: {_number('b')}), lambda b: b IS NOT NULL)"
_digits = lambda b: f"array_to_string(list_transform({b}, lambda d: CAST(round(d * 10000) AS BIGINT)), ',')"
_status = lambda x, states, rest: f"CASE {' '.join(f'WHEN said IN ({names}) THEN {name}' for name, names in states.items())} ELSE '{rest}' END"

SQL_PARSED = rf"""o AS (SELECT page_id AS id, page_id % 4 AS own, {ANSWER} AS raw FROM pages),
p AS (SELECT id, own, CASE WHEN json_valid(raw) THEN raw::JSON WHEN json_valid(regexp_extract(raw, '(?s)\{{.*\}}')) THEN regexp_extract(raw, '(?s)\{{.*\}}')::JSON END AS v FROM o)"""
_list = lambda name, most: f"SELECT id, own, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS v FROM (SELECT id, own, ({_items(f"v -> '$.{name}'")})[1:{most}] AS l FROM p)"
_said = lambda x="v": f"lower(coalesce({_text(x, 'status')}, ''))"
SQL_VALID = lambda b: f"CASE WHEN len({b}) = 4 AND list_min({b}) >= 0 AND list_max({b}) <= 1 AND {b}[3] > {b}[1] AND {b}[4] > {b}[2] AND ({b}[3] - {b}[1]) * ({b}[4] - {b}[2]) >= 0.002 THEN {b} END"
TABLE_STATUS = "CASE WHEN said IN ('reconstructed', 'complete', 'visible', 'usable', 'ok') THEN 'reconstructed' WHEN said IN ('partial', 'fragmented', 'missed') THEN 'partial' WHEN said IN ('not_visible', 'not visible', 'missing', 'not_found') THEN 'not_visible' ELSE 'uncertain' END"
FIGURE_STATUS = "CASE WHEN said IN ('crop_ready', 'visible', 'ready', 'usable', 'ok') THEN 'crop_ready' WHEN said IN ('fragmented', 'partial', 'broken') THEN 'fragmented' WHEN said IN ('not_visible', 'not visible', 'missing', 'not_found') THEN 'not_visible' ELSE 'uncertain' END"
SQL_TABLES = f"""ti AS ({_list("table_completions", 4)}),
tc AS (SELECT id, n, {_page("v")} AS page, {_text("v", "label")} AS label, replace({_said()}, '-', '_') AS said, {_strings("(v -> '$.headers')")} AS headers,
  list_filter(list_transform(({_items("(v -> '$.rows')")})[1:20], lambda r: ({_strings("r")})[1:12]), lambda r: len(r) > 0) AS rows, {_text("v", "markdown")} AS md, {_box("(v -> '$.bbox_norm')")} AS box, {_number("(v -> '$.confidence')")} AS confidence FROM ti),
tw AS (SELECT *, {TABLE_STATUS} AS status, {SQL_VALID("box")} AS b, CASE WHEN len(headers) > 0 THEN len(headers) WHEN len(rows) > 0 THEN list_max(list_transform(rows, lambda r: len(r))) END AS w FROM tc)"""
SQL_FIGURES = f"""fi AS ({_list("figure_completions", 4)}),
fc AS (SELECT id, n, {_page("v")} AS page, {_text("v", "label")} AS label, left({_text("v", "caption")}, 600) AS caption, replace({_said()}, '-', '_') AS said, {_box("(v -> '$.bbox_norm')")} AS box, {_box("(v -> '$.caption_bbox_norm')")} AS cbox, {_number("(v -> '$.confidence')")} AS confidence FROM fi),
fs AS (SELECT *, {FIGURE_STATUS} AS status, {SQL_VALID("box")} AS b, {SQL_VALID("cbox")} AS c FROM fc),
ft AS (SELECT *, coalesce(NOT (b[3] + 0.015 < c[1] OR c[3] + 0.015 < b[1] OR b[4] + 0.015 < c[2] OR c[4] + 0.015 < b[2]), false) AS touch FROM fs),
fm AS (SELECT *, touch AND c[2] >= b[2] AND c[2] <= b[4] AS below, touch AND NOT (c[2] >= b[2] AND c[2] <= b[4]) AND c[4] >= b[2] AND c[4] <= b[4] AS above FROM ft),
fe AS (SELECT *, CASE WHEN below THEN greatest(c[2] - 0.005::DOUBLE, b[2] + 0.02::DOUBLE) END AS bottom, CASE WHEN above THEN least(c[4] + 0.005::DOUBLE, b[4] - 0.02::DOUBLE) END AS top FROM fm),
fr AS (SELECT *, status <> 'not_visible' AND b IS NOT NULL AS seen, [greatest(b[1] - 0.015::DOUBLE, 0), greatest(greatest(coalesce(top, b[2]) - 0.01::DOUBLE, 0), coalesce(top, 0)), least(b[3] + 0.015::DOUBLE, 1), least(least(coalesce(bottom, b[4]) + 0.01::DOUBLE, 1), coalesce(bottom, 1))] AS r FROM fe)"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_outputs(table(spark, sf_dir, "pages").selectExpr("page_id AS id", "page_id % 4 AS page", f"{ANSWER} AS raw"))


def _numbers(box: str):
    return F.array_join(F.transform(box, lambda d: F.round(d * 10000).cast("long").cast("string")), ",")


def _bars(column: str, inner: str = "/"):
    return F.array_join(F.transform(column, lambda r: F.array_join(r, inner)), ";")


@query("p22_page_reports", f"WITH {SQL_PARSED} SELECT id, own AS page, CASE WHEN v IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN list_contains(json_keys(v), 'patches') THEN 'discarded_model_text_patches' ELSE '' END AS warnings FROM p")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("id", "page", "status", F.array_join("warnings", ",").alias("warnings"))


@query(
    "p22_visual_objects",
    f"""WITH {SQL_PARSED}, i AS ({_list("visual_objects", 3)}), s AS (SELECT *, coalesce({_text("v", "kind")}, 'unknown') AS said FROM i)
SELECT id, n::INT AS n, {_page("v")} AS page, CASE WHEN lower(said) IN ('figure', 'table', 'chart', 'diagram', 'resource', 'equation') THEN said WHEN lower(said) IN ('section', 'text', 'code', 'dataset') THEN 'resource' ELSE 'unknown' END AS kind,
  {_text("v", "label")} AS label, left({_text("v", "summary")}, 180) AS summary, {_text("v", "confidence")} AS confidence FROM s""",
)
def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.visual_objects(_outputs(spark, sf_dir))


@query(
    "p22_table_completions",
    f"""WITH {SQL_PARSED}, {SQL_TABLES}, tk AS (
  SELECT *, CASE WHEN len(headers) > 0 THEN headers WHEN w > 0 THEN list_transform(range(1, w + 1), lambda i: 'col_' || i) END AS heads, status <> 'not_visible' AS seen FROM tw
), tl AS (
  SELECT *, list_filter([CASE WHEN seen AND b IS NULL THEN 'invalid_or_missing_table_bbox' END, CASE WHEN seen AND len(headers) = 0 AND len(rows) = 0 THEN 'table_completion_has_no_cells' END, CASE WHEN seen AND len(list_filter(rows, lambda r: len(r) <> w)) > 0 THEN 'table_row_width_mismatch' END,
    CASE WHEN seen AND len(list_filter(flatten(rows), lambda x: contains(replace(x, ' ', ''), '×10') AND NOT contains(x, '^') AND NOT contains(x, '⁰'))) > 0 THEN 'table_values_may_need_superscript_or_exponent_validation' END], lambda x: x IS NOT NULL) AS found FROM tk
)
SELECT id, n::INT AS n, page, label, status, array_to_string(headers, '/') AS headers, coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(r, '/')), ';'), '') AS rows,
  CASE WHEN contains(md, '|') THEN md WHEN w IS NOT NULL THEN array_to_string(list_concat(['| ' || array_to_string(heads, ' | ') || ' |', '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], list_transform(rows, lambda r: '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: coalesce(r[i], '')), ' | ') || ' |')), chr(10)) END AS markdown,
  coalesce(CASE WHEN seen AND b IS NOT NULL THEN {_digits("[greatest(b[1] - 0.025::DOUBLE, 0), greatest(b[2] - 0.015::DOUBLE, 0), least(b[3] + 0.025::DOUBLE, 1), least(b[4] + 0.015::DOUBLE, 1)]")} END, '') AS refined, CASE WHEN len(found) = 0 THEN 'ok' ELSE 'warning' END AS validation, array_to_string(found, ',') AS warnings, confidence FROM tl""",
)
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.table_completions(_outputs(spark, sf_dir))
    return rows.select("id", "n", "page", "label", "status", F.array_join("headers", "/").alias("headers"), _bars("rows").alias("rows"), "markdown", _numbers("refined_box").alias("refined"), "validation", F.array_join("warnings", ",").alias("warnings"), "confidence")


@query(
    "l6_refined_figures",
    f"""WITH {SQL_PARSED}, {SQL_FIGURES}, fl AS (
  SELECT *, list_filter([CASE WHEN status <> 'not_visible' AND b IS NULL THEN 'invalid_or_missing_figure_bbox' END, CASE WHEN seen AND (below OR above) THEN 'refined_figure_bbox_removed_caption_overlap' END, CASE WHEN seen AND (r[3] - r[1]) * (r[4] - r[2]) < 0.004 THEN 'refined_figure_bbox_too_small' END], lambda x: x IS NOT NULL) AS found FROM fr
)
SELECT id, n::INT AS n, page, label, length(caption) AS n_caption, status, CASE WHEN seen THEN {_digits("r")} ELSE '' END AS refined, CASE WHEN len(list_filter(found, lambda x: x <> 'refined_figure_bbox_removed_caption_overlap')) = 0 THEN 'ok' ELSE 'warning' END AS validation, array_to_string(found, ',') AS warnings, confidence FROM fl""",
)
def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.figure_completions(_outputs(spark, sf_dir))
    return rows.select("id", "n", "page", "label", F.length("caption").cast("long").alias("n_caption"), "status", _numbers("refined_box").alias("refined"), "validation", F.array_join("warnings", ",").alias("warnings"), "confidence")


REPAIR = "CASE status WHEN 'reconstructed' THEN 'ok' WHEN 'crop_ready' THEN 'ok' WHEN 'not_visible' THEN 'missed' ELSE 'uncertain' END"
REPAIR_SAID = f"CASE WHEN {_said()} IN ('ok', 'found', 'present') THEN 'ok' WHEN {_said()} IN ('missing', 'not_found', 'missed') THEN 'missed' ELSE 'uncertain' END"


@query(
    "l8_repairs",
    f"""WITH {SQL_PARSED}, {SQL_TABLES}, {SQL_FIGURES}, tr AS ({_list("table_repairs", 1)}), gr AS ({_list("figure_repairs", 1)})
SELECT id, 'table' AS kind, n::INT AS n, {_page("v")} AS page, {_text("v", "label")} AS label, {REPAIR_SAID} AS status, array_to_string(({_strings("(v -> '$.header')")})[1:5], '/') AS header, array_to_string(list_transform(({_items("(v -> '$.sample_rows')")})[1:1], lambda r: array_to_string(({_strings("r")})[1:5], '/')), ';') AS samples FROM tr
UNION ALL SELECT id, 'table', (n + 1)::INT, page, label, {REPAIR}, array_to_string(headers[1:8], '/'), coalesce(array_to_string(list_transform(rows[1:2], lambda r: array_to_string(r, '/')), ';'), '') FROM tw
UNION ALL SELECT id, 'figure', n::INT, {_page("v")}, {_text("v", "label")}, {REPAIR_SAID}, '', '' FROM gr
UNION ALL SELECT id, 'figure', (n + 1)::INT, page, label, {REPAIR}, '', '' FROM fs""",
)
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's own repairs, and those that completions stand for."""
    read = _outputs(spark, sf_dir)
    tables = O.table_repairs(read).select("id", F.lit("table").alias("kind"), "n", "page", "label", "status", F.array_join("header", "/").alias("header"), _bars("sample_rows").alias("samples"))
    return tables.unionByName(O.figure_repairs(read).select("id", F.lit("figure").alias("kind"), "n", "page", "label", "status", F.lit("").alias("header"), F.lit("").alias("samples")))


@query("p22_layout_notes", f"WITH {SQL_PARSED}, i AS ({_list('layout_warnings', 3)}) SELECT id, own AS page, n::INT AS n, left(CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE v::VARCHAR END, 180) AS note FROM i WHERE json_type(v) IN ('VARCHAR', 'OBJECT')")
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.layout_notes(_outputs(spark, sf_dir))


@query(
    "l8_merged_documents",
    f"""WITH {SQL_PARSED}, c AS (SELECT id % 10 AS id, v IS NULL AS failed, least(len({_items("v -> '$.visual_objects'")}), 3) AS objects, least(len({_items("v -> '$.table_completions'")}), 4) AS tables, least(len({_items("v -> '$.figure_completions'")}), 4) AS figures,
  least(len({_items("v -> '$.table_repairs'")}), 1) + least(len({_items("v -> '$.figure_repairs'")}), 1) AS own, len(list_filter(({_items("v -> '$.layout_warnings'")})[1:3], lambda w: json_type(w) IN ('VARCHAR', 'OBJECT'))) AS notes FROM p)
SELECT id, count(*) AS pages, count(*) FILTER (failed) AS failed, sum(objects)::BIGINT AS objects, sum(tables)::BIGINT AS tables, sum(figures)::BIGINT AS figures, sum(own + tables + figures)::BIGINT AS repairs, sum(notes)::BIGINT AS notes FROM c GROUP BY 1""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of all pages."""
    return O.merged_document(_outputs(spark, sf_dir).withColumn("id", F.col("id") % 10))
