"""Registered queries of literature captures: answers made from `pages`, written to a committed folder, read with pruning and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.registry import query
from lodeworks.plans.templates import filled, pick
from lodeworks.sources import committed, literature
from lodeworks.sources.shared import shared_root
from lodeworks.sources.tables import table

N = "page_id"
TEXT = f"CAST({N} AS STRING)"


def _semantic(k: int) -> str:
    return filled(
        '{"title":"T@n@","paperId":@own@,"year":@year@,"citationCount":@cited@,"referenceCount":2.5,"venue":"V","abstract":5,"authors":[{"name":"A@n@"},{"x":1},{"name":"B"}],"externalIds":{"DOI":@doi@,"ArXiv":"1706.@n@"},"url":"https://s.example/@n@/' + str(k) + '"@pdf@}',
        n=TEXT, own=pick(N, f'"p{k}"', "null"), year=pick(N, "2020", '"2020"', "null", "-1", step=k), cited=pick(N, "7", "null", step=k), doi=pick(N, f'"10.1/{k}"', "null", "3", step=k),
        pdf=pick(N, ',"openAccessPdf":{"url":"https://p.example/x.pdf"}', ',"openAccessPdf":null', "", ',"openAccessPdf":{"url":" "}', step=k),
    )


def _openalex(k: int) -> str:
    return filled(
        '{"id":"https://openalex.org/W@n@' + str(k) + '","title":"O@n@","doi":@doi@,"publication_year":@year@,"cited_by_count":3,"authorships":[{"author":{"display_name":"A"}},{"author":{}},{"author":{"display_name":"B@n@"}}],"primary_location":{"pdf_url":"https://pp.example/@n@","source":{"display_name":"S"}},"best_oa_location":@best@,"open_access":{"is_oa":@oa@},"abstract_inverted_index":{"b":[1],"a":[0,2]},"referenced_works":@refs@}',
        n=TEXT, doi=pick(N, '"https://doi.org/10.2/a"', "null", '"10.2/b"', step=k), year=pick(N, "2019", "2019.5", step=k), best=pick(N, "null", '{"pdf_url":null,"license":"cc"}', '{"pdf_url":"https://bb.example/x"}', step=k), oa=pick(N, "true", '"true"', "false", step=k), refs=pick(N, '["W1","W2",5]', "null", step=8 * k),
    )


def _crossref(k: int) -> str:
    return filled(
        '{"DOI":"10.3/@n@","title":@title@,"author":[{"given":"G","family":"F@n@"},{"family":"X"},{}],"published-print":@print@,"published-online":{"date-parts":[[2018,1]]},"container-title":["J"],"reference-count":@refs@,"license":[{"URL":"https://l.example"}],"URL":"https://c.example/@n@","abstract":"ab"}',
        n=TEXT, title=pick(N, f'["C{k}","D"]', "[]", '"C"', step=k), print=pick(N, '{"date-parts":[[2016]]}', '{"date-parts":[[null]]}', "null", step=k), refs=pick(N, "12", '"12"', step=k),
    )


def _dblp(k: int) -> str:
    return filled(
        '{"info":{"title":"D <sub>@n@</sub>  <i>x</i>","url":"https://dblp.example/@n@/' + str(k) + '","doi":@doi@,"year":@year@,"venue":"DV","authors":{"author":@authors@}}}',
        n=TEXT, doi=pick(N, "null", '"10.4/a"', step=k), year=pick(N, '"2019"', "2019", '"x"', step=k), authors=pick(N, '[{"text":"A"},"B",{"x":1}]', '{"text":"C"}', '"D"', "5", step=k),
    )


PROVIDERS = ["semantic", "openalex", "crossref", "dblp"]
KINDS = ["search", "get", "citations", "references"]
SHAPES = {
    ("semantic", "search"): filled('{"data":[@a@,@b@]}', a=_semantic(1), b=_semantic(2)), ("semantic", "get"): _semantic(1), ("semantic", "citations"): filled('{"data":[{"citingPaper":@a@},{"other":1},{"citingPaper":@b@}]}', a=_semantic(1), b=_semantic(2)),
    ("semantic", "references"): filled('{"data":[{"citedPaper":@a@}]}', a=_semantic(2)), ("openalex", "search"): filled('{"results":[@a@,@b@]}', a=_openalex(1), b=_openalex(2)), ("openalex", "get"): _openalex(1), ("openalex", "citations"): filled('{"results":[@a@]}', a=_openalex(2)),
    ("openalex", "references"): "'no JSON'", ("crossref", "search"): filled('{"message":{"items":[@a@,@b@]}}', a=_crossref(1), b=_crossref(2)), ("crossref", "get"): filled('{"message":@a@}', a=_crossref(1)), ("crossref", "citations"): "'{}'", ("crossref", "references"): "'[]'",
    ("dblp", "search"): filled('{"result":{"hits":{"hit":[@a@,{"noinfo":1},{"info":{"title":5}},@b@]}}}', a=_dblp(1), b=_dblp(2)), ("dblp", "get"): filled('{"result":{"hits":{"hit":[@a@,@b@]}}}', a=_dblp(1), b=_dblp(2)), ("dblp", "citations"): "'{\"result\":{}}'", ("dblp", "references"): "'{}'",
}


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """provider, kind, id, raw: one answer a page, all providers and kinds in turn."""
    p, k = f"element_at(array({', '.join(map(repr, PROVIDERS))}), CAST({N} % 4 + 1 AS INT))", f"element_at(array({', '.join(map(repr, KINDS))}), CAST(floor({N} / 4) % 4 + 1 AS INT))"
    raw = "CASE " + " ".join(f"WHEN {N} % 4 = {PROVIDERS.index(a)} AND floor({N} / 4) % 4 = {KINDS.index(b)} THEN {sql}" for (a, b), sql in SHAPES.items()) + " END"
    return table(spark, sf_dir, "pages").selectExpr(f"{p} AS provider", f"{k} AS kind", f"{N} AS id", f"{raw} AS raw")


def _stored(spark: SparkSession, sf_dir: str, **only) -> DataFrame:
    path = f"{shared_root(spark)}/captures-{uuid.uuid4().hex}"
    committed.save(captured(spark, sf_dir), path, by="provider,kind")
    return committed.load(spark, path, **only)


def _records(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    found = literature.paper_records(_stored(spark, sf_dir, provider=provider))
    return found.withColumn("authors", F.array_join("authors", ";")).withColumn("pos", F.col("pos").cast("int"))


def _sql_rows(provider: str, places: dict[str, list[tuple[int, int]]]) -> str:
    """n, kind, pos, k of the records of a provider's answers; k tells which of the made records it is."""
    each = [f"SELECT page_id AS n, '{kind}' AS kind, {pos} AS pos, {k} AS k FROM pages WHERE page_id % 4 = {PROVIDERS.index(provider)} AND page_id // 4 % 4 = {KINDS.index(kind)}" for kind, found in places.items() for pos, k in found]
    return "r AS (" + " UNION ALL ".join(each) + "), s AS (SELECT *, n // k AS m FROM r)"


def _sql_paper(provider: str, places: dict[str, list[tuple[int, int]]], **fields: str) -> str:
    kinds = {"year": "BIGINT", "citations": "BIGINT", "references": "BIGINT", "open_access": "BOOLEAN"}
    columns = ", ".join(f"""({fields.get(f, 'NULL')})::{kinds.get(f, 'VARCHAR')} AS "{'paper_id' if f == 'id' else f}\"""" for f in literature.FIELDS)
    return f"WITH {_sql_rows(provider, places)} SELECT '{provider}' AS provider, kind, n AS id, pos, {columns} FROM s"


BOTH = [(0, 1), (1, 2)]
SQL_DOI = "CASE m % 3 WHEN 0 THEN '10.1/' || k END"


@query(
    "a8_semantic_records",
    _sql_paper(
        "semantic", {"search": BOTH, "get": [(0, 1)], "citations": [(0, 1), (2, 2)], "references": [(0, 2)]}, id=f"coalesce({SQL_DOI}, CASE WHEN n % 2 = 0 THEN 'p' || k END, 'T' || n)", title="'T' || n", authors="'A' || n || ';B'", year="CASE m % 4 WHEN 0 THEN 2020 END", venue="'V'",
        doi=SQL_DOI, arxiv_id="'1706.' || n", semantic_id="CASE WHEN n % 2 = 0 THEN 'p' || k END", url="'https://s.example/' || n || '/' || k", pdf_url="CASE m % 4 WHEN 0 THEN 'https://p.example/x.pdf' END", citations="CASE m % 2 WHEN 0 THEN 7 END", open_access="CASE m % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END",
    ),
)
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "semantic")


SQL_OPENALEX_DOI = "CASE m % 3 WHEN 0 THEN '10.2/a' WHEN 2 THEN '10.2/b' END"


@query(
    "a10_openalex_records",
    _sql_paper(
        "openalex", {"search": BOTH, "get": [(0, 1)], "citations": [(0, 2)]}, id=f"coalesce({SQL_OPENALEX_DOI}, 'https://openalex.org/W' || n || k)", title="'O' || n", authors="'A;B' || n", year="CASE m % 2 WHEN 0 THEN 2019 END", venue="'S'", abstract="'a b a'", doi=SQL_OPENALEX_DOI,
        openalex_id="'https://openalex.org/W' || n || k", url="'https://openalex.org/W' || n || k", pdf_url="CASE m % 3 WHEN 0 THEN 'https://pp.example/' || n WHEN 2 THEN 'https://bb.example/x' END", citations="3", references="CASE n // (8 * k) % 2 WHEN 0 THEN 3 END", open_access="CASE m % 3 WHEN 0 THEN true WHEN 2 THEN false END", license="CASE m % 3 WHEN 1 THEN 'cc' END",
    ),
)
def openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "openalex")


@query("a10_referenced_records", "SELECT 'openalex' AS provider, page_id AS id, i::INT AS pos, 'W' || (i + 1) AS url FROM pages, range(2) t(i) WHERE page_id % 4 = 1 AND page_id // 4 % 4 = 1 AND page_id // 8 % 2 = 0")
def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literature.referenced_records(_stored(spark, sf_dir, provider="openalex", kind="get"))


@query(
    "a11_crossref_records",
    _sql_paper(
        "crossref", {"search": BOTH, "get": [(0, 1)]}, id="'10.3/' || n", title="CASE m % 3 WHEN 0 THEN 'C' || k ELSE '' END", authors="'G F' || n || ';X'", year="CASE m % 3 WHEN 0 THEN 2016 WHEN 2 THEN 2018 END", venue="'J'", abstract="'ab'", doi="'10.3/' || n", url="'https://c.example/' || n",
        references="CASE m % 2 WHEN 0 THEN 12 END", license="'https://l.example'",
    ),
)
def crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "crossref")


@query(
    "a7_dblp_records",
    _sql_paper(
        "dblp", {"search": [(0, 1), (3, 2)], "get": [(0, 1)]}, id="coalesce(CASE m % 2 WHEN 1 THEN '10.4/a' END, 'https://dblp.example/' || n || '/' || k)", title="'D ' || n || ' <i>x</i>'", authors="CASE m % 4 WHEN 0 THEN 'A;B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE '' END", year="CASE m % 3 WHEN 0 THEN 2019 END", venue="'DV'",
        doi="CASE m % 2 WHEN 1 THEN '10.4/a' END", url="'https://dblp.example/' || n || '/' || k",
    ),
)
def dblp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "dblp")


@query("a30_capture_manifest", "SELECT ['semantic', 'openalex', 'crossref', 'dblp'][page_id % 4 + 1] AS provider, ['search', 'get', 'citations', 'references'][page_id // 4 % 4 + 1] AS kind, count(*) AS answers FROM pages GROUP BY ALL")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder's manifests say of it, without reading a file."""
    path = f"{shared_root(spark)}/captures-{uuid.uuid4().hex}"
    committed.save(captured(spark, sf_dir), path, by="provider,kind")
    return committed.manifest_files(spark, path).groupBy(F.col("values.provider").alias("provider"), F.col("values.kind").alias("kind")).agg(F.sum("rows").alias("answers"))
