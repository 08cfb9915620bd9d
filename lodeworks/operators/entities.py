"""Merging and caching of small keyed groups: materials, canonical records, errors, enrichment, recency."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower


def merge_materials(rows: DataFrame, key: str) -> DataFrame:
    """One row per URL (case of A-Z ignored) and key; the first stays.  rows: key, pos, url, kind."""
    low = ascii_lower(F.col("url"))
    return rows.groupBy(key, low.alias("low")).agg(F.min_by(F.struct("pos", "url", "kind"), "pos").alias("m")).select(key, "m.*")


def absorb(rows: DataFrame, key: str, order: list[Column], firsts: list[str], highest: list[str]) -> DataFrame:
    """One record per key: in the given order the first value that is not null, and the highest counts."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = rows.withColumn("place", rank)
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    return ranked.groupBy(key).agg(*map(value, firsts), *(F.max(c).alias(c) for c in highest), F.count("*").alias("n_merged"))


def first_errors(events: DataFrame) -> DataFrame:
    """events (source, seq, error) -> the first error of each source."""
    return events.where("error is not null").groupBy("source").agg(F.min_by("error", "seq").alias("error"), F.count("*").alias("n_errors"))


def first_provider(rows: DataFrame, query: str, priority: str) -> DataFrame:
    """All rows of the first provider, by priority, that has any for the query."""
    return rows.withColumn("best", F.min(priority).over(Window.partitionBy(query))).where(F.col(priority) == F.col("best")).drop("best")


def enrich(sources: DataFrame, contents: DataFrame, most: int) -> DataFrame:
    """sources (session_id, pos, url) with fetched content (url, content, error) for the first `most`; notes for failures."""
    fetched = contents.select(F.col("url").alias("u"), F.col("content").alias("fetched"), "error")
    joined = sources.join(fetched, (F.col("url") == F.col("u")) & (F.col("pos") < most), "left")
    text = F.when(F.trim(F.coalesce("fetched", F.lit(""))) != "", F.col("fetched")).when(F.col("error").isNotNull(), F.concat(F.lit("[not fetched: "), F.col("error"), F.lit("]")))
    return joined.select("session_id", "pos", "url", text.alias("content"))


def fallback_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents (doc_id, n_bytes) without any section get one that covers them."""
    alone = docs.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    made = alone.select("doc_id", F.lit("sec_000_paper").alias("section_id"), F.lit(0).cast("long").alias("section_start"), F.col("n_bytes").alias("section_end"))
    return sections.unionByName(made)


def recently_used(accesses: DataFrame, capacity: int) -> DataFrame:
    """accesses (cache_id, seq, op: get or put, key) -> cache_id, key, place: what each cache holds at the end, newest first.

    A get refreshes a key only while the cache holds it, so a cache's log is replayed in order: it is sorted within its partition
    (which spills) and streamed, and a task holds `capacity` keys of one cache at a time.
    """
    capacity = max(1, capacity)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[str, None] = OrderedDict()
        current = None

        def rows() -> pd.DataFrame:
            keys = list(reversed(held))
            return pd.DataFrame({"cache_id": [current] * len(keys), "key": keys, "place": range(len(keys))})

        for pdf in batches:
            for cache, op, key in pdf[["cache_id", "op", "key"]].itertuples(index=False):
                if cache != current:
                    if held:
                        yield rows()
                    held.clear()
                    current = cache
                if op == "put" or key in held:
                    held.pop(key, None)
                    held[key] = None
                    if len(held) > capacity:
                        held.popitem(last=False)
        if held:
            yield rows()

    ordered = accesses.select(F.col("cache_id").cast("long").alias("cache_id"), "seq", "op", "key").repartition("cache_id").sortWithinPartitions("cache_id", "seq")
    return ordered.mapInPandas(replay, "cache_id long, key string, place long")
