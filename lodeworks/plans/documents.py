"""Registered queries of document clean-up, chunking and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import documents as D
from lodeworks.plans.registry import query
from lodeworks.sources.tables import table, values

SQL_LINES = "ln AS (SELECT doc_id, unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS l FROM src)), s AS (SELECT doc_id, trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')) AS norm FROM ln)"
NOISY = ["Conference 2020\nbody one\nConference 2020\nbody two\nConference  2020\nend", "12\na\n12\nb\n12\nFigure 1: x\nFigure 1: x\nFigure 1: x", "Journal of X\nhttp://a.b\nhttp://a.b\nhttp://a.b\nJournal of X", "", "Copyright\n\nCopyright\n\nCopyright\nTable 1\n7\n7"]
NOISY_ROWS = ", ".join("({}, '{}')".format(1_000_000_000 + i, x.replace("\n", "\\n")) for i, x in enumerate(NOISY))
SQL_NOISY = ", ".join("({}, replace('{}', '\\n', chr(10)))".format(1_000_000_000 + i, x.replace("\n", "\\n")) for i, x in enumerate(NOISY))
SQL_SRC = f"src AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {SQL_NOISY}) v(doc_id, text))"


def with_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = values(spark, NOISY_ROWS, "doc_id, text").select(F.col("doc_id").cast("long"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden)


@query(
    "g3_text_signals",
    f"WITH {SQL_SRC}, {SQL_LINES}, c AS (SELECT doc_id, norm, count(*) AS n FROM s WHERE norm <> '' GROUP BY 1, 2) SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) FILTER (n >= 3) AS n_repeated, coalesce(sum(n) FILTER (starts_with(lower(norm), 'fig.') OR starts_with(lower(norm), 'figure ')), 0)::BIGINT AS n_figures, coalesce(sum(n) FILTER (starts_with(lower(norm), 'table ')), 0)::BIGINT AS n_tables, coalesce(sum(n) FILTER (contains(norm, 'http://') OR contains(norm, 'https://')), 0)::BIGINT AS n_urls, coalesce(sum(n) FILTER (length(norm) <= 18), 0)::DOUBLE / sum(n) AS short_ratio FROM c GROUP BY 1",
)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_signals(with_golden(spark, sf_dir))


@query(
    "h2_repeated_noise",
    f"WITH {SQL_SRC}, {SQL_LINES} SELECT doc_id, norm, count(*) AS n FROM s WHERE octet_length(encode(norm)) >= 3 AND length(norm) <= 90 AND NOT starts_with(lower(norm), 'fig.') AND NOT starts_with(lower(norm), 'figure ') AND NOT starts_with(lower(norm), 'table ') AND NOT contains(norm, 'http://') AND NOT contains(norm, 'https://') AND (regexp_matches(norm, '^[0-9\\s]+$') OR regexp_matches(lower(norm), 'proceedings|arxiv|copyright|preprint|conference|journal')) GROUP BY 1, 2 HAVING count(*) >= 3",
)
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated_noise(with_golden(spark, sf_dir))


@query("h5_blank_normalize", f"WITH {SQL_SRC} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: rtrim(x, ' ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', chr(10)), '\\n+$', '') AS text FROM src")
def blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_golden(spark, sf_dir).select("doc_id", D.collapse_blank_lines(F.col("text")).alias("text"))


#: The clean-up as folds over lists: lines without noise, hyphens undone, lines joined to paragraphs.
SQL_CLEAN = f"""{SQL_LINES}, noise AS (
  SELECT doc_id, norm FROM s WHERE octet_length(encode(norm)) >= 3 AND length(norm) <= 90 AND NOT regexp_matches(lower(norm), '^(fig\\.|figure |table )') AND NOT regexp_matches(lower(norm), 'https?://')
  AND (regexp_matches(norm, '^[0-9\\s]+$') OR regexp_matches(lower(norm), 'proceedings|arxiv|copyright|preprint|conference|journal')) GROUP BY 1, 2 HAVING count(*) >= 3
), num AS (SELECT doc_id, count(*) AS n FROM noise GROUP BY 1
), l2 AS (
  SELECT doc_id, list_filter(l, lambda x: NOT coalesce(list_contains(bad, trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'))), false)) AS l
  FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS l FROM src)) LEFT JOIN (SELECT doc_id, list(norm) AS bad FROM noise GROUP BY 1) USING (doc_id)
), l3 AS (
  SELECT doc_id, list_reduce(list_prepend({{'o': []::VARCHAR[], 'h': NULL::VARCHAR}}, list_transform(l, lambda x: {{'o': [x], 'h': x}})), lambda a, x:
    CASE WHEN a.h IS NOT NULL AND regexp_matches(a.h, '(^|[^\\s\\p{{Z}}])-[\\s\\p{{Z}}]*$') AND regexp_matches(x.h, '^[^\\p{{L}}]*\\p{{Ll}}')
      THEN {{'o': list_append(a.o[:-2], regexp_replace(a.h, '-[\\s\\p{{Z}}]*$', '') || regexp_replace(x.h, '^[\\s\\p{{Z}}]+', '')), 'h': NULL}} ELSE {{'o': list_append(a.o, x.h), 'h': x.h}} END).o AS l FROM l2
), l4 AS (
  SELECT doc_id, list_transform(l, lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS l FROM l3
), l5 AS (
  SELECT doc_id, list_reduce(list_prepend({{'o': []::VARCHAR[], 'open': false}}, list_transform(l, lambda x: {{'o': [x], 'open': regexp_matches(lower(x), '^(#|\\||fig\\.|figure |table |https?://)') OR suffix(x, ':') OR (starts_with(x, '[') AND contains(x, ']')) OR len(regexp_extract_all(x, '[=<>+/-]')) >= 2}})), lambda a, x:
    CASE WHEN x.o[1] = '' THEN {{'o': a.o, 'open': false}} WHEN x.open THEN {{'o': list_append(a.o, x.o[1]), 'open': false}}
      WHEN a.open AND NOT regexp_matches(a.o[-1], '[.:;]$') AND (length(x.o[1]) <= 96 OR regexp_matches(x.o[1], '^[^\\p{{L}}]*\\p{{Ll}}')) THEN {{'o': list_append(a.o[:-2], a.o[-1] || ' ' || x.o[1]), 'open': true}}
      ELSE {{'o': list_append(a.o, x.o[1]), 'open': true}} END).o AS l FROM l4
)"""


@query("h6_clean_text", f"WITH {SQL_SRC}, {SQL_CLEAN} SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS text, coalesce(n, 0)::BIGINT AS n_noise, 'removed ' || n || ' repeated layout lines' AS warning FROM l5 LEFT JOIN num USING (doc_id)")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clean_documents(with_golden(spark, sf_dir))


TAILS = ["Intro\nREFERENCES\n[1] a  \n\n\n\n[2] b\n\n", "x\nreferences one\ny\nReferences two", "x\nReference list\nz", "none here", "references first line", ""]
TAIL_ROWS = ", ".join("({}, '{}')".format(i, x.replace("\n", "\\n")) for i, x in enumerate(TAILS))
SQL_TAILS = ", ".join("({}, replace('{}', '\\n', chr(10)))".format(i, x.replace("\n", "\\n")) for i, x in enumerate(TAILS))


@query(
    "h7_reference_tail",
    f"WITH t AS (SELECT doc_id, regexp_extract(text, '(?is).*(\\nreferences.*)', 1) AS a, regexp_extract(text, '(?is).*(\\nreference.*)', 1) AS b FROM (SELECT * FROM (VALUES {SQL_TAILS}) v(doc_id, text) UNION ALL SELECT 1000 + doc_id, text || chr(10) || 'Reference ' || lang || chr(10) || left(text, 30) FROM documents)), r AS (SELECT doc_id, CASE WHEN a <> '' THEN a ELSE b END AS x FROM t) SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', chr(10)), '\\n+$', ''), 30000) AS tail FROM r",
)
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal rows, and the documents with a reference section of one line behind them."""
    golden = values(spark, TAIL_ROWS, "doc_id, text").select(F.col("doc_id").cast("long"), "text")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit("\nReference "), "lang", F.lit("\n"), F.left("text", F.lit(30))).alias("text"))
    return D.reference_tails(golden.unionByName(d))


@query("h8_page_offsets", "SELECT conv_id, turn, (sum(octet_length(encode(text)) + 2) OVER w - octet_length(encode(text)) - 2)::BIGINT AS byte_start, (sum(octet_length(encode(text)) + 2) OVER w - 2)::BIGINT AS byte_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


SQL_OFFSETS = "o AS (SELECT conv_id, turn, role, (sum(octet_length(encode(text)) + 2) OVER w - octet_length(encode(text)) - 2)::BIGINT AS byte_start, (sum(octet_length(encode(text)) + 2) OVER w - 2)::BIGINT AS byte_end, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), t AS (SELECT conv_id, max(byte_end) AS total FROM o GROUP BY 1), sec AS (SELECT conv_id, turn AS section_id, byte_start AS section_start, coalesce(lead(byte_start) OVER (PARTITION BY conv_id ORDER BY byte_start), total) AS section_end FROM o JOIN t USING (conv_id) WHERE role = 'user')"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns open sections."""
    c = table(spark, sf_dir, "conversations")
    o = D.page_offsets(c, "conv_id", "turn", "text").withColumn("total", F.max("byte_end").over(Window.partitionBy("conv_id")))
    starts = o.join(c.where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("section_id"), F.col("byte_start").alias("section_start"), "total")
    return D.section_ranges(starts, "conv_id", "section_start", F.col("total")).drop("total")


@query("j2_section_ranges", f"WITH {SQL_OFFSETS} SELECT * FROM sec")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir)


@query("j3_chunk_section_overlap", f"WITH {SQL_OFFSETS} SELECT o.conv_id, o.turn, sec.section_id FROM o JOIN sec ON o.conv_id = sec.conv_id AND o.byte_end >= section_start AND o.byte_start <= section_end")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return D.overlapping(o, sections(spark, sf_dir), "conv_id").select("conv_id", "turn", "section_id")


@query("j4_section_digests", f"WITH {SQL_OFFSETS}, m AS (SELECT sec.conv_id, section_id, o.turn, left(o.text, 40) AS digest FROM o JOIN sec ON o.conv_id = sec.conv_id AND o.byte_end >= section_start AND o.byte_start <= section_end QUALIFY row_number() OVER (PARTITION BY sec.conv_id, section_id ORDER BY o.turn) <= 3) SELECT conv_id, section_id, string_agg(digest, ' | ' ORDER BY turn) AS digests FROM m GROUP BY 1, 2")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    o = D.page_offsets(c, "conv_id", "turn", "text").join(c.select("conv_id", "turn", F.left("text", F.lit(40)).alias("digest")), ["conv_id", "turn"])
    near = D.overlapping(o, sections(spark, sf_dir), "conv_id").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "section_id").orderBy("turn"))).where("n <= 3")
    firsts = near.groupBy("conv_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest"))).alias("x"))
    return firsts.select("conv_id", "section_id", F.array_join(F.transform("x", lambda s: s["digest"]), " | ").alias("digests"))


def chunked(spark: SparkSession, sf_dir: str, anchors: bool) -> DataFrame:
    """Documents with their lines as paragraphs, in overlapping chunks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return D.chunks(d, "fast", anchors=anchors)


@query("i2_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests restate the rule."""
    return chunked(spark, sf_dir, False).drop("chunk")


@query("i4_anchors")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.anchors_of(chunked(spark, sf_dir, True))


#: Paragraphs as byte ranges: positions of blank lines, by the lengths before them.
@query(
    "i1_paragraph_ranges",
    "WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS n FROM documents), o AS (SELECT *, (sum(octet_length(encode(p)) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - octet_length(encode(p)) - 2)::BIGINT AS byte_start FROM p) "
    "SELECT doc_id, byte_start, byte_start + octet_length(encode(p)) AS byte_end FROM o WHERE p <> '' UNION ALL SELECT doc_id, 0, octet_length(encode(replace(text, chr(10), chr(10) || chr(10)))) FROM documents WHERE regexp_matches(text, '^\\n*$')",
)
def paragraph_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return D.paragraph_ranges(d)


@query("g6_paper_budget", "SELECT doc_id, length(text)::BIGINT AS n_chars, (length(text) // 4)::BIGINT AS n_tokens, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_chars"), F.floor(n / 4).cast("long").alias("n_tokens"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query("a20_valid_utf8", "SELECT doc_id, true AS valid, length(text) AS n FROM documents")
def utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    text = F.col("raw").cast("string")
    return raw.select("doc_id", F.is_valid_utf8(text).alias("valid"), F.char_length(text).alias("n"))
