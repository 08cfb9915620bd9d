"""Registered queries of ranking, fusion, filters and text functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import ranking as R
from lodeworks.plans.registry import query
from lodeworks.plans.templates import by_page, by_page_sql
from lodeworks.sources.shared import materialize
from lodeworks.sources.tables import table, values

#: The stated query set of the retrieval queries.
QUERIES = [(1, "The thing and that thion"), (2, "ereat thand ing with"), (3, "der die enung"), (4, "les de tion que"), (5, "ción los mente"), (6, "paper")]
QUERY_ROWS = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
LOW, UP = T.LOWER, T.UPPER
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"

SQL_NORM = lambda c: f"translate(trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), '{UP}', '{LOW}')"
SQL_TOKENS = lambda c: f"list_filter(string_split({SQL_NORM(c)}, ' '), lambda t: octet_length(encode(t)) >= 3 AND NOT list_contains({STOP}, t))"
SQL_QUERIES = f"q AS (SELECT query_id, query, {SQL_TOKENS('query')} AS qt, {SQL_NORM('query')} AS qn FROM (VALUES {QUERY_ROWS}) v(query_id, query))"
SQL_DOCS = f"d AS (SELECT doc_id, n_chars, left(text, 80) AS title, {SQL_TOKENS('text')} AS dt, {SQL_TOKENS('left(text, 80)')} AS tt, {SQL_NORM('left(text, 80)')} AS tn FROM documents)"
SQL_HITS = "h AS (SELECT q.*, d.*, len(list_filter(qt, lambda t: list_contains(dt, t))) AS hits, len(list_filter(qt, lambda t: list_contains(tt, t))) AS title_hits FROM q, d)"


def queries_table(spark: SparkSession) -> DataFrame:
    return values(spark, QUERY_ROWS, "query_id, query").select(F.col("query_id").cast("long"), "query")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first 80 characters are the title, the year comes from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.left("text", F.lit(80)).alias("title"), F.when(F.col("doc_id") % 7 != 0, 1985 + F.col("doc_id") % 40).alias("year"), F.col("n_chars").alias("citations"), (F.col("doc_id") % 5 == 0).alias("has_pdf"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0).alias("open_access"))


SQL_PAPERS = f"p AS (SELECT doc_id, text, left(text, 80) AS title, CASE WHEN doc_id % 7 <> 0 THEN 1985 + doc_id % 40 END AS year, n_chars AS citations, doc_id % 5 = 0 AS has_pdf, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS open_access, {SQL_TOKENS('text')} AS dt, {SQL_TOKENS('left(text, 80)')} AS tt, {SQL_NORM('left(text, 80)')} AS tn FROM documents)"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their titles' tokens, computed once a paper."""
    return papers(spark, sf_dir).drop("text").withColumns({"title_tokens": T.meaningful_tokens(F.col("title")), "title_norm": T.normalize_title(F.col("title"))})


@query("h11_title_normalize", f"SELECT doc_id, {SQL_NORM('text')} AS title FROM documents")
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@query("d6_meaningful_tokens", f"SELECT doc_id, len({SQL_TOKENS('text')})::INT AS n_tokens, sha256(array_to_string({SQL_TOKENS('text')}, '|')) AS tokens_sha256 FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.meaningful_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", "|"), 256).alias("tokens_sha256"))


SQL_LEAST = "CASE WHEN len(qt) = 0 THEN 0 WHEN len(qt) <= 2 THEN 1 ELSE 2 END"


@query("e3_relevance_filter", f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_HITS} SELECT query_id, doc_id, hits::BIGINT AS hits FROM h WHERE hits >= {SQL_LEAST}")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevant_pairs(queries_table(spark), table(spark, sf_dir, "documents"))


@query("e4_strong_overlap", f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_HITS} SELECT query_id, doc_id, hits::BIGINT AS hits FROM h WHERE hits >= CASE WHEN len(qt) <= 2 THEN {SQL_LEAST} ELSE 3 END")
def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevant_pairs(queries_table(spark), table(spark, sf_dir, "documents"), "strong")


@query("e5_precise_filter", f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_HITS} SELECT query_id, doc_id FROM h WHERE len(qt) = 0 OR title_hits >= {SQL_LEAST} OR contains(tn, qn)")
def precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against all titles."""
    rows = titled(spark, sf_dir).select("doc_id", "title_tokens", "title_norm").join(F.broadcast(R.prepared_queries(queries_table(spark))))
    return rows.where(R.is_precise()).select("query_id", "doc_id")


@query("e6_year_filter", "SELECT o_orderkey, year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS year FROM orders) WHERE year IS NULL OR year BETWEEN 1994 AND 1996")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate").cast("long")).alias("year"))
    return o.where(R.in_years(F.col("year"), 1994, 1996))


@query("e7_open_access_filter", f"WITH {SQL_PAPERS} SELECT doc_id FROM p WHERE coalesce(open_access, false) OR has_pdf")
def open_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where(F.coalesce("open_access", F.lit(False)) | F.col("has_pdf")).select("doc_id")


SQL_CITATION = "(40 * CASE WHEN c = 0 THEN 0 ELSE length(c::VARCHAR) - 1 END + least(c, 1000) // 25)"
SQL_SCORE = "1000 * (tn = qn)::INT + 100 * len(list_filter(qt, lambda t: list_contains(tt, t))) + 20 * len(list_filter(qt, lambda t: list_contains(dt, t))) + 3 * has_pdf::INT + coalesce(open_access, false)::INT"


@query(
    "d1_relevance_score",
    f"WITH {SQL_QUERIES}, {SQL_PAPERS}, s AS (SELECT *, least(coalesce(citations, 0), 10000) AS c FROM q, p WHERE len(list_filter(qt, lambda t: list_contains(dt, t))) >= {SQL_LEAST}) "
    f"SELECT query_id, doc_id, ({SQL_SCORE} + CASE WHEN c = 0 THEN 0 ELSE length(c::VARCHAR) - 1 END)::BIGINT AS by_relevance, ({SQL_SCORE} + {SQL_CITATION})::BIGINT AS by_citations, "
    f"({SQL_SCORE} + CASE WHEN c = 0 THEN 0 ELSE length(c::VARCHAR) - 1 END + least(greatest(coalesce(year, 0) - 1900, 0), 200))::BIGINT AS by_date FROM s",
)
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the relevant pairs, for each order."""
    q = queries_table(spark)
    rows = R.relevant_pairs(q, table(spark, sf_dir, "documents")).join(titled(spark, sf_dir), "doc_id").join(F.broadcast(R.prepared_queries(q)), "query_id")
    return rows.select("query_id", "doc_id", *(R.relevance_score(s).alias(f"by_{s}") for s in ("relevance", "citations", "date")))


SQL_LISTS = """
r AS (
  SELECT query_id, doc_id, 0 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) - 1 AS position FROM h WHERE hits > 0
  UNION ALL SELECT query_id, doc_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) - 1 FROM h WHERE hits > 0
  UNION ALL SELECT query_id, doc_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(quality, -1) DESC, n_chars, doc_id) - 1 FROM h LEFT JOIN labels USING (doc_id) WHERE hits > 0
), f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (61 + position)) AS rrf, min({'a': list_no, 'b': position}) AS seen FROM r WHERE position < 50 GROUP BY 1, 2)"""


def with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, hits, n_chars, quality of all pairs that share a token, written once."""
    docs = table(spark, sf_dir, "documents")
    hits = R.hits_by_join(queries_table(spark), docs).join(docs.select("doc_id", "n_chars"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return materialize(hits, "token-hits")


def ranked_lists(hits: DataFrame, depth: int = 50) -> DataFrame:
    """query_id, doc_id, list_no, position: what three providers return, by token hits, by length, by quality label; a page of depth rows each.

    A filter on row_number itself lets each task stop at depth rows before the shuffle.
    """
    orders = [[F.desc("hits"), "doc_id"], [F.desc("n_chars"), "doc_id"], [F.desc(F.coalesce("quality", F.lit(-1))), "n_chars", "doc_id"]]
    one = lambda n, order: hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= depth).select("query_id", "doc_id", F.lit(n).alias("list_no"), (F.col("place") - 1).alias("position"))
    a, b, c = (one(n, o) for n, o in enumerate(orders))
    return a.unionByName(b).unionByName(c)


@query("c5_rank_fusion", f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_HITS}, {SQL_LISTS} SELECT query_id, doc_id, round(rrf, 12) AS rrf FROM f")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(ranked_lists(with_hits(spark, sf_dir)), key="doc_id").select("query_id", "doc_id", F.round("rrf", 12).alias("rrf"))


@query(
    "f2_federated_top_k",
    f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_HITS}, {SQL_LISTS}, {SQL_PAPERS}, s AS (SELECT q.query_id, p.doc_id, f.rrf, f.seen, least(coalesce(citations, 0), 10000) AS c, {SQL_SCORE} AS score FROM f JOIN q USING (query_id) JOIN p USING (doc_id) WHERE len(list_filter(qt, lambda t: list_contains(dt, t))) >= CASE WHEN len(qt) = 0 THEN 0 WHEN len(qt) <= 2 THEN 1 ELSE 2 END), "
    "t AS (SELECT query_id, doc_id, round(rrf, 12) AS rrf, seen, score + CASE WHEN c = 0 THEN 0 ELSE length(c::VARCHAR) - 1 END AS score FROM s) "
    "SELECT query_id, doc_id, score::BIGINT AS score, rrf, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, seen, doc_id)::INT AS rank FROM t QUALIFY rank <= 10",
)
def federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rankings -> fusion -> relevance filter -> integer score -> stable order -> top k."""
    found = with_hits(spark, sf_dir)
    q = F.broadcast(R.prepared_queries(queries_table(spark)))
    fused = R.fuse(ranked_lists(found), key="doc_id")  # a few providers' pages a query
    rows = fused.join(found.select("query_id", "doc_id", "hits"), ["query_id", "doc_id"]).join(q, "query_id").where(F.col("hits") >= F.col("least")).join(titled(spark, sf_dir), "doc_id")
    rows = rows.select("query_id", "doc_id", R.relevance_score().alias("score"), F.round("rrf", 12).alias("rrf"), "first_seen")
    return R.top_k(rows, "query_id", [F.desc("score"), F.desc("rrf"), F.col("first_seen"), F.col("doc_id")], 10).drop("first_seen")


@query("d13_best_title_match", f"WITH {SQL_PAPERS}, m AS (SELECT a.item_id, p.doc_id, p.citations FROM (SELECT doc_id AS item_id, {SQL_NORM('left(text, 80)')} AS n FROM documents) a JOIN p ON p.tn = a.n WHERE a.n <> '') SELECT item_id, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY citations DESC, doc_id) = 1")
def best_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the most cited paper with the same normalised title."""
    p = papers(spark, sf_dir).select("doc_id", "citations", T.normalize_title(F.col("title")).alias("norm"))
    asked = p.where("norm <> ''").select(F.col("doc_id").alias("item_id"), F.col("norm").alias("n"))
    best = p.groupBy("norm").agg(F.min_by("doc_id", F.struct(-F.col("citations"), F.col("doc_id"))).alias("doc_id"))
    return asked.join(best, F.col("n") == F.col("norm")).select("item_id", "doc_id")


@query("f1_truncate", "SELECT doc_id, left(text, 200) AS content, length(text) AS original_length, length(text) > 200 AS truncated FROM documents")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("t")).select("doc_id", "t.*")


@query("p19_inverted_abstract", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS abstract FROM documents")
def abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inverted to word -> positions and restored, within the row: nothing is shuffled.

    Sorted with their places, equal words are runs; a run's places are its word's positions.
    """
    words = F.filter(F.split("text", r"[\t\n\f\r ]+"), lambda w: w != "")
    placed = table(spark, sf_dir, "documents").select("doc_id", F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))).alias("s"))
    at = lambda i: F.get(F.col("s"), i)
    starts = F.filter(F.transform("s", lambda x, i: i), lambda i: (i == 0) | (at(i)["w"] != at(i - 1)["w"]))
    runs = placed.select("doc_id", "s", starts.alias("starts"), F.size("s").alias("n"))
    run = lambda a, j: F.slice(F.col("s"), a + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.col("n")) - a)
    entries = F.transform("starts", lambda a, j: F.struct(at(a)["w"].alias("w"), F.transform(run(a, j), lambda x: x["p"]).alias("at")))
    return runs.select("doc_id", F.map_from_entries(entries).alias("index")).select("doc_id", T.inverted_abstract(F.col("index")).alias("abstract"))


PAPER_ROWS = """(1, 0, 0, 'Deep Nets', 2019, '10.1/A', NULL, NULL, NULL, 5), (1, 0, 1, 'Other', NULL, NULL, '2001.00001', NULL, NULL, NULL), (1, 1, 0, 'deep  nets!', 2021, '10.1/B', NULL, NULL, 'W7', 9),
(1, 1, 1, 'Deep Nets', 2025, NULL, NULL, NULL, 'W9', 1), (1, 2, 0, 'OTHER', 2020, '10.1/a', NULL, 's2', NULL, 3), (2, 0, 0, '', NULL, NULL, NULL, NULL, NULL, NULL), (2, 1, 0, '', 2001, NULL, NULL, 'S2', NULL, 4), (2, 2, 0, 'Émile', 2000, NULL, NULL, 's2', NULL, 7)"""


@query("c6_merge_papers")
def merge_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_papers(values(spark, PAPER_ROWS, "query_id, list_no, position, title, year, doi, arxiv, semantic, openalex, citations").withColumn("query_id", F.col("query_id").cast("long")))


@query(
    "c6_paper_key",
    "SELECT query_id, list_no, position, coalesce('doi:' || lower(doi), 'arxiv:' || lower(arxiv), 'semantic:' || lower(semantic), 'openalex:' || lower(openalex), 'title:' || translate(trim(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '" + UP + "', '" + LOW + "') || ':' || coalesce(year::VARCHAR, '')) AS key FROM (VALUES " + PAPER_ROWS + ") v(query_id, list_no, position, title, year, doi, arxiv, semantic, openalex, citations)",
)
def paper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.functions.identifiers import paper_key

    p = values(spark, PAPER_ROWS, "query_id, list_no, position, title, year, doi, arxiv, semantic, openalex, citations")
    return p.select("query_id", "list_no", "position", paper_key(*(F.col(c) for c in ("doi", "arxiv", "semantic", "openalex")), T.normalize_title(F.col("title")), F.col("year")).alias("key"))


IDENTIFIERS = ["10.5555/lode.17", "doi:10.5555/lode.17", "DOI: 10.48550/arXiv.2301.04567", "10.48550/arxiv.2301.04567.pdf", "doi:lode", "https://arxiv.org/abs/2301.04567v2", "http://export.arxiv.org/pdf/2301.04567.pdf?x=1", "https://arxiv.org/list/abs/2301", "https://openalex.org/W77", "https://dblp.org/rec/lode", "https://lode.example/a", "2301.04567", "2301.04567.pdf", "W77", "W", "fedcba9876543210fedcba9876543210", "ore bodies in old mines", " 2301.0456 ", "LODE: a survey", "2301.045", "arxiv:2301.04567"]
IDENTIFIER_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(IDENTIFIERS))


@query(
    "s2_identifier_classify",
    f"""WITH v AS (SELECT id, trim(raw) AS t, trim(regexp_replace(trim(raw), '^(?i:doi:)', '')) AS b FROM {by_page_sql(IDENTIFIER_ROWS, "id, raw", "")} v),
w AS (SELECT *, regexp_replace(trim(regexp_extract(b, '^10\\.48550/(?:arXiv|arxiv)\\.(.*)$', 1)), '(\\.pdf)+$', '') AS u, lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') AS is_url, '^[0-9]{{4}}\\.[^.]{{4,}}(\\..*)?$' AS shape, '^[A-Za-z]+://[^/?#]*/(?:abs|pdf)/([^?#]*)' AS path FROM v),
k AS (SELECT *, CASE WHEN regexp_matches(u, shape) THEN 'arxiv of doi' WHEN b LIKE '10.%' THEN 'doi' WHEN is_url AND suffix(host, 'arxiv.org') AND regexp_matches(t, path) THEN 'arxiv of url' WHEN is_url AND suffix(host, 'openalex.org') THEN 'openalex' WHEN is_url AND suffix(host, 'dblp.org') THEN 'dblp' WHEN is_url THEN 'url' WHEN regexp_matches(regexp_replace(t, '\\.pdf$', ''), shape) THEN 'arxiv' WHEN regexp_matches(t, '^W[0-9]*$') THEN 'openalex' WHEN regexp_matches(t, '^[0-9A-Fa-f]{{32,}}$') THEN 'semantic' ELSE 'query' END AS rule FROM w)
SELECT id, regexp_extract(rule, '^\\w+') AS kind, CASE rule WHEN 'arxiv of doi' THEN u WHEN 'doi' THEN b WHEN 'arxiv of url' THEN regexp_replace(regexp_extract(t, path, 1), '\\.pdf$', '') ELSE t END AS value FROM k""",
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.functions.identifiers import classify_identifier

    return by_page(spark, sf_dir, IDENTIFIER_ROWS, "id, raw", "").select("id", classify_identifier(F.col("raw")).alias("c")).select("id", "c.*")
