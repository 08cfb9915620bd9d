"""Rank fusion, relevance scores, filters and top-k over ranked lists of papers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodeworks.functions.text import least_hits, meaningful_tokens, normalize_title, raw_tokens, strong_hits, token_hits

RRF_K = 60


def fuse(lists: DataFrame, query: str = "query_id", key: str = "key", position: str = "position") -> DataFrame:
    """Reciprocal rank fusion: query, key, score, first_position.

    position is 0-based in its list; a key that a list holds twice counts twice.  One shuffle, on
    (query, key), with partial sums.
    """
    return lists.groupBy(query, key).agg(F.sum(1.0 / (RRF_K + 1 + F.col(position))).alias("rrf"), F.min(F.struct(*(c for c in ("list_no", position) if c in lists.columns))).alias("first_seen"))


def citation_term(citations: Column, by_citations: bool = False) -> Column:
    c = F.least(F.coalesce(citations, F.lit(0)), F.lit(10_000)).cast("long")
    magnitude = F.when(c == 0, 0).otherwise(F.char_length(c.cast("string")) - 1)
    return (40 * magnitude + F.floor(F.least(c, F.lit(1000)) / 25)) if by_citations else magnitude


def date_term(year: Column) -> Column:
    return F.least(F.greatest(F.coalesce(year, F.lit(0)) - 1900, F.lit(0)), F.lit(200))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """One row: asked, the distinct tokens of all queries (query_id, query; a stated set)."""
    return queries.select(F.explode(meaningful_tokens(F.col("query"))).alias("t")).agg(F.collect_set("t").alias("asked"))


def hits_by_join(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, hits for pairs that share a token: an equi-join on tokens, never a cross join.

    A text's tokens are cut down to those that any query asks for (one broadcast row) before they are exploded, so a
    document sends a handful of rows whatever its length.
    """
    wanted = queries.select("query_id", F.explode(meaningful_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    with_asked = docs.select("doc_id", raw_tokens(F.col("text")).alias("tokens")).join(F.broadcast(asked_tokens(queries)))
    have = with_asked.select("doc_id", F.explode(F.array_intersect("tokens", "asked")).alias("t"))
    return have.join(wanted, F.col("t") == F.col("token")).groupBy("query_id", "doc_id").agg(F.sum("times").alias("hits"))


def prepared_queries(queries: DataFrame) -> DataFrame:
    """query_id, query_tokens, query_norm, least (hits of a relevant result), strong (of a strong overlap)."""
    tokens = queries.select("query_id", meaningful_tokens(F.col("query")).alias("query_tokens"), normalize_title(F.col("query")).alias("query_norm"))
    n = F.size("query_tokens")
    return tokens.select("*", least_hits(n).alias("least"), strong_hits(n).alias("strong"))


def relevant_pairs(queries: DataFrame, docs: DataFrame, needed: str = "least") -> DataFrame:
    """query_id, doc_id, hits of the results that a query lets pass; a query without tokens passes all documents, with no hits.

    needed: least, or strong for a strong overlap.
    """
    q = prepared_queries(queries)
    hits = hits_by_join(queries, docs).join(F.broadcast(q), "query_id").where(F.col("hits") >= F.col(needed)).select("query_id", "doc_id", "hits")
    everything = docs.select("doc_id").join(F.broadcast(q.where(F.size("query_tokens") == 0).select("query_id")))
    return hits.unionByName(everything.select("query_id", "doc_id", F.lit(0).cast("long").alias("hits")))


def relevance_score(sort: str = "relevance") -> Column:
    """The integer score of rows with query_tokens, query_norm, title_tokens, title_norm, hits, citations, year, has_pdf and open_access."""
    score = 1000 * (F.col("title_norm") == F.col("query_norm")).cast("int") + 100 * token_hits(F.col("query_tokens"), F.col("title_tokens")) + 20 * F.col("hits")
    score = score + citation_term(F.col("citations"), sort == "citations") + 3 * F.col("has_pdf").cast("int") + F.coalesce("open_access", F.lit(False)).cast("int")
    return (score + date_term(F.col("year")) if sort == "date" else score).cast("long")


def is_precise() -> Column:
    """Of rows with query_tokens, query_norm, least, title_tokens and title_norm: enough hits in the title, or the query stands in it."""
    return (F.size("query_tokens") == 0) | (token_hits(F.col("query_tokens"), F.col("title_tokens")) >= F.col("least")) | F.col("title_norm").contains(F.col("query_norm"))


def in_years(year: Column, low: int | None, high: int | None) -> Column:
    """An unknown year passes."""
    return year.isNull() | ((year >= (low if low is not None else -(1 << 31))) & (year <= (high if high is not None else (1 << 31) - 1)))


def top_k(rows: DataFrame, query: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each query (between 1 and 50), numbered from 1; Spark stops each partition's sort at the limit."""
    w = Window.partitionBy(query).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(max(limit, 1), 50))


#: Of a paper, beside its identifiers: what the first that has it gives, the larger of two, lists that grow by new URLs.
FIRST_GIVEN = ["authors", "venue", "abstract", "url", "pdf_url", "open_access", "license"]
LARGER = ["citations", "references"]
GROWING = ["sources", "materials"]


def merge_papers(papers: DataFrame) -> DataFrame:
    """The exact, order-dependent merge of ranked paper lists, query by query.

    papers: query_id, list_no, position, title, year, doi, arxiv, semantic, openalex, citations, and any of FIRST_GIVEN (authors:
    array of strings), references, sources and materials (arrays of structs with url).  A paper joins the first entry whose present
    title (normalised) is the same, if the years are at most two apart or unknown; else the entry of its key; else it makes one.
    An entry keeps what it has and takes what it lacks; counts become the larger; sources and materials with new URLs are
    appended.  The order of arrival decides, so a query's lists are folded in one group; they hold a few providers' pages, bounded
    by the providers' page size, whatever the number of queries.
    """
    extra = [c for c in (*FIRST_GIVEN, *LARGER[1:], *GROWING) if c in papers.columns]
    prepared = papers.withColumn("norm", normalize_title(F.coalesce("title", F.lit(""))))

    def known(value: object) -> object:
        """None for nothing; lists as lists."""
        if isinstance(value, (list, tuple, np.ndarray)):
            return list(value) or None
        return None if value is None or pd.isna(value) else value

    def absorb(e: dict, row: dict) -> None:
        for c in ("year", "doi", "arxiv", "semantic", "openalex", *(x for x in extra if x in FIRST_GIVEN)):
            e[c] = row[c] if e[c] is None else e[c]
        for c in ("citations", *(x for x in extra if x in LARGER)):
            e[c] = max((x for x in (e[c], row[c]) if x is not None), default=None)
        for c in (x for x in extra if x in GROWING):
            have = list(e[c] or [])
            e[c] = have + [x for n, x in enumerate(row[c] or []) if x["url"] not in {y["url"] for y in (*have, *(row[c][:n]))}]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        entries: list[dict] = []
        by_key: dict[str, int] = {}
        by_title: dict[str, list[int]] = {}
        for row in pdf.sort_values(["list_no", "position"], kind="stable").to_dict("records"):
            row = {k: known(v) for k, v in row.items()}
            year, norm, hit = row["year"], row["norm"] or "", None
            for i in by_title.get(norm, []) if norm else []:
                have = entries[i]["year"]
                if have is None or year is None or abs(have - year) <= 2:
                    hit = i
                    break
            named = next((f"{n}:{row[n].lower()}" for n in ("doi", "arxiv", "semantic", "openalex") if row[n] is not None), None)
            key = named or f"title:{norm}:{'' if year is None else int(year)}"
            if hit is None:
                hit = by_key.get(key)
            if hit is None:
                hit = by_key[key] = len(entries)
                entries.append({c: row[c] for c in ("query_id", "title", "year", "doi", "arxiv", "semantic", "openalex", "citations", *extra)} | {"key": key, "rrf": 0.0, "n_merged": 0, "first_seen": hit})
                by_title.setdefault(norm, []).append(hit)
            e = entries[hit]
            if e["n_merged"]:
                absorb(e, row)
            if not e["title"] and row["title"]:
                e["title"] = row["title"]
                by_title.setdefault(norm, []).append(hit)
            e["rrf"] += 1.0 / (RRF_K + 1 + row["position"])
            e["n_merged"] += 1
        out = pd.DataFrame(entries)
        for c in ("year", *(x for x in LARGER if x in out.columns)):
            out[c] = out[c].astype("Int64")
        return out

    types = {f.name: f for f in papers.schema.fields}
    base = StructType.fromDDL("query_id long, title string, year long, doi string, arxiv string, semantic string, openalex string, citations long")
    result = StructType([*base.fields, *(StructField("references", LongType()) if c == "references" else types[c] for c in extra), *StructType.fromDDL("key string, rrf double, n_merged long, first_seen long").fields])
    return prepared.groupBy("query_id").applyInPandas(fold, result)
