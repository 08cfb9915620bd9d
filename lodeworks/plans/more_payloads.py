"""Registered queries of the further payload parsers, over literal payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql, filled, pick
from lodeworks.sources import more_payloads as M
from lodeworks.sources.tables import table, values

HITS = ['{"result":{"hits":{"hit":[{"info":{"title":"T1","year":"2020","doi":"10.1/a","authors":{"author":[{"text":"A"},{"text":"B"}]}}},{"info":{"title":"T2","authors":{"author":{"text":"C"}}}},{"info":{"year":"2000"}}]}}}', '{"result":{"hits":{}}}']
EXTRACTS = ['{"query":{"pages":{"12":{"pageid":12,"title":"Golay","extract":"A code."}}}}', '{"query":{"pages":{"-1":{"title":"None","extract":" "}}}}', "{}"]
ITEMS = ['{"Data":{"Items":[{"Title":"a","Url":"u","VoteUpCount":3},{"Title":"b"}]}}', "{}"]
N = "page_id"
ANSWER = '{"is_accepted":@ok@,"score":@score@,"body":"<p>B@n@</p>"@markdown@,"owner":@owner@,"comments":@comments@}'


def _answer(k: int) -> str:
    return filled(
        ANSWER, n=f"CAST({N} AS STRING)", ok=pick(N, "true", "null", "false", '"true"', step=k), score=pick(N, "5", "-2", "null", "1.5", step=k), markdown=pick(N, "", ',"body_markdown":null', ',"body_markdown":"m &amp; &#233;"', step=k),
        owner=pick(N, '{"display_name":"a &lt;b&gt;"}', "null", "{}", step=k), comments=pick(N, '[{"owner":{"display_name":"c"},"body":"x &quot;"},{}]', "null", step=k),
    )


SQL_ANSWERS = """w AS (SELECT page_id AS n, i AS pos, page_id // (i + 1) AS m FROM pages, range(3) t(i) WHERE page_id % 9 <> 8), r AS (
  SELECT n AS question_id, pos, m % 4 = 0 AS accepted, CASE m % 4 WHEN 0 THEN 5 WHEN 1 THEN -2 ELSE 0 END::BIGINT AS score, CASE WHEN m % 3 = 0 THEN 'a <b>' ELSE '' END AS author, CASE m % 3 WHEN 0 THEN '<p>B' || n || '</p>' WHEN 1 THEN '' ELSE 'm & é' END AS body,
    CASE WHEN m % 2 = 0 THEN 'c: x "|: ' ELSE '' END AS comments FROM w)"""
OUTPUTS = ['```json\\n{"sections":[{"anchor_id":"c1","heading":"Intro","confidence":2}],"entities":[],"patches":[]}\\n```', '{"s":[{"a":"c2","h":"Method","c":0.5}],"e":[{"k":"figure","a":"c3","l":"F"}]}', '{"s":[["c4","Results",-1],["c5"]],"p":[["c6","a","b",0.9]]}', "no json", None]


def _rows(items: list[str | None]) -> str:
    return ", ".join(f"({i}, " + ("NULL" if x is None else f"'{x}'") + ")" for i, x in enumerate(items))


@query("p9_bibliography_hits", f"SELECT * FROM {by_page_sql("(0, 0::BIGINT, 'T1', 2020::BIGINT, '10.1/a', 'A; B'), (0, 1, 'T2', NULL, NULL, 'C')", 'id, pos, title, year, doi, authors', turns=len(HITS))} v")
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bibliography_hits(by_page(spark, sf_dir, _rows(HITS), "id, raw"))


@query("p17_page_extract", f"WITH p AS (SELECT id, (CAST(raw::JSON -> '$.query.pages.*' AS JSON[]))[1] AS v FROM {by_page_sql(_rows(EXTRACTS), "id, raw", "raw")} v) SELECT id, v ->> '$.title' AS title, CASE WHEN trim(v ->> '$.extract') <> '' THEN v ->> '$.extract' END AS extract FROM p")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(EXTRACTS), "id, raw", "raw").select("id", M.page_extract(F.col("raw")).alias("p")).select("id", "p.*")


@query("p13_question_items", f"SELECT * FROM {by_page_sql("(0, 'a', 'u', 3::BIGINT, 0::BIGINT), (0, 'b', NULL, 0, 0)", 'id, title, url, votes, comments', turns=len(ITEMS))} v")
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(ITEMS), "id, raw").select("id", F.explode(M.question_items(F.col("raw"))).alias("x")).select("id", "x.*")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions of pages (one in seven without items), and their answers (one in nine unreadable)."""
    pages = table(spark, sf_dir, "pages")
    item = filled('{"items":[{"title":"T &amp; @n@","body":"b"@markdown@}]}', n=f"CAST({N} AS STRING)", markdown=pick(N, "", ',"body_markdown":"M &gt;"'))
    answers = filled('{"items":[@a@,@b@,@c@]}', a=_answer(1), b=_answer(2), c=_answer(3))
    return pages.selectExpr(f"{N} AS question_id", f"CASE WHEN {N} % 7 = 6 THEN '{{\"items\":[]}}' ELSE {item} END AS raw"), pages.selectExpr(f"{N} AS question_id", f"CASE WHEN {N} % 9 = 8 THEN 'error' ELSE {answers} END AS raw")


def _comments(column: str):
    return F.array_join(F.transform(column, lambda c: F.concat_ws(": ", c["author"], c["body"])), "|")


@query("p18_answers", f"WITH {SQL_ANSWERS} SELECT question_id, pos::INT AS pos, accepted, score, author, body, comments FROM r")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.answers(_asked(spark, sf_dir)[1]).withColumn("comments", _comments("comments"))


@query(
    "a16_questions",
    f"""WITH {SQL_ANSWERS}, o AS (SELECT question_id, string_agg(pos::VARCHAR || CASE WHEN accepted THEN '*' ELSE '' END, ',' ORDER BY accepted DESC, score DESC, pos) AS answers FROM r GROUP BY 1)
SELECT page_id AS question_id, 'T & ' || page_id AS title, CASE WHEN page_id % 2 = 1 THEN 'M >' ELSE 'b' END AS body, coalesce(o.answers, '') AS answers FROM pages LEFT JOIN o ON o.question_id = page_id WHERE page_id % 7 <> 6""",
)
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question is mandatory, its answers are best-effort: accepted first, then by score."""
    found = M.questions(*_asked(spark, sf_dir))
    return found.withColumn("answers", F.array_join(F.transform("answers", lambda a: F.concat(a["pos"].cast("string"), F.when(a["accepted"], "*").otherwise(""))), ","))


@query("p12_article_lists", "SELECT page_id, 0::BIGINT AS pos, 'https://list.example/link?x=' || page_id AS url, 'Title ' || page_id AS title, 'sum mary' AS summary FROM pages UNION ALL SELECT page_id, 1, 'https://a.example/' || page_id, 'B', '' FROM pages")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "concat('<ul><li><h3><a href=\"/link?x=', page_id, '\">Title <em>', page_id, '</em></a></h3><p>sum  mary</p></li><li><h3><a href=\"https://a.example/', page_id, '\">B</a></h3></li></ul>', html)"
    return M.article_lists(table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html")), "https://list.example")


@query("p21_chunk_outputs")
def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _rows(OUTPUTS), "chunk_id, raw").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return M.chunk_outputs(rows).select("chunk_id", "valid", F.to_json("sections").alias("sections"), F.to_json("entities").alias("entities"), F.to_json("patches").alias("patches"))


CODES = ['{"Code":0,"Data":{}}', '{"Code":"7"}', '{"Code":null}', "{}", "no json", None]


@query("p13_answer_code", f"SELECT * FROM {by_page_sql('(0, 0::BIGINT), (1, 7), (2, -1), (3, -1), (4, -1), (5, -1)', 'id, code', turns=len(CODES))} v")
def answer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, _rows(CODES), "id, raw").select("id", M.answer_code(F.col("raw")).alias("code"))


#: Conversations as captured comment lists: every other turn without an author, every fifth without a body.
@query("p18_comment_lists", "SELECT conv_id AS issue_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS author, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS body, 'd' || turn AS created_at FROM conversations")
def comment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    one = F.struct("turn", F.struct(F.when(t % 2 == 0, F.col("role")).alias("login")).alias("user"), F.when(t % 5 != 4, F.col("text")).alias("body"), F.concat(F.lit("d"), t.cast("string")).alias("submitted_at"))
    raw = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("issue_id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("raw"))
    return M.comments(raw, reviews=True)


@query("p10_referenced_works", "SELECT doc_id AS id, i::INT AS pos, 'W' || (doc_id + i) AS work FROM documents, range(4) r(i) WHERE i < doc_id % 5")
def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.sources import payloads as P

    n = (F.col("doc_id") % 5).cast("int")
    works = F.slice(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("W"), (F.col("doc_id") + i).cast("string"))), F.lit(1), n)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct(works.alias("referenced_works"))).alias("raw"))
    return P.referenced_works(rows)
