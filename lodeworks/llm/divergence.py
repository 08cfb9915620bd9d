"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Counting.  A task counts the terms of the documents that it reads for each (lang, source), and in how many of them each
is; Spark adds these up.  A language keeps the terms that enough of its documents have.

Layout.  A language's kept terms are dealt by hash to shards of about SHARD_TERMS, and numbered in each.  Its sources are dealt
to blocks, so that there are at most MOST_BLOCKS.  A cell (lang, shard, block) holds the counts of a block's sources for a
shard's terms, sparse and compressed; sources and blocks without any such term have cells too.

Systolic rotation.  Cells stay where they are: dealt out once, by their key, and kept there.  In each round of a round-robin
tournament (one block fixed, the others turn) a language's blocks are paired; of each pair the later one's cells travel to the
earlier one's place, and the meeting gives the values of both directions.  So only half of the vectors
move in a round, every two blocks meet once, a task holds two cells, and a lost executor costs one round.  In round
zero each block meets itself and, for each of its sources, a heap keeps the shard's best terms.  Values are sums over
shards, which Spark adds up.

All arithmetic is in 64-bit integers and exact for languages of up to 9 * 10^15 occurrences.

Defined cases: null text, lang and source are empty ones; an empty lang or source is one like any other; a source without kept
terms has a row for each peer (0 where the language keeps no term); a language's only source has no peers;
repeated rows and ids count as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import binary_column, materialize, pack_arrays, parallelism, release, unpack_arrays

LEAST_DOCS, TOP = 10, 10
SHARD_TERMS = 4096
CELL = 1 << 20  # counts of a cell, written out
MOST_BLOCKS = 16
#: A task's counts are sent on beyond so many entries, or characters of them.
HELD_ENTRIES, HELD_BYTES = 400_000, 64 << 20
#: Letters A-Z become small, other bytes below 0x80 that are not letters part terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCALE_STEPS = 3  # of a factor of 1000: shares are of 10^9

TALLY = "lang string, source string, term string, n long, docs long"
MET = "lang string, a long, b long, term string, value long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def tallies(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: partial counts; a row without term for each group that a task has met."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        """A batch for each group, which is let go."""
        while held:
            (lang, source), (counts, docs) = held.popitem()
            terms = list(counts)
            n = len(terms) + 1
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([*terms, None], pa.string()), pa.array([*counts.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for piece in slices(batch):
                data, ends = binary_column(piece, "text")
                for lang, source, a, b in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    if (lang, source) not in held:
                        held[lang, source] = Counter(), Counter()
                    counts, docs = held[lang, source]
                    found = terms_of(bytes(data[a:b]))
                    counts.update(found)
                    docs.update(set(found))
                    size += b - a
                if size > HELD_BYTES or sum(len(c) for c, _ in held.values()) > HELD_ENTRIES:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(run, TALLY)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), digit group by digit group."""
    below = totals + 2 * terms
    rest, out = counts + 2, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def partner(block, rounds: int, blocks):
    """The block that a block meets in this round (1, 2, ...), itself if it rests; columns or numbers.

    The circle: with m places (an even number), place m - 1 stays and meets r, the others meet 2 r - block modulo m - 1.
    """
    last = blocks + blocks % 2 - 1
    turned = (F.lit(2 * (rounds - 1)) - block + 2 * last) % last
    met = F.when(block == last, F.lit(rounds - 1)).when(turned == block, last).otherwise(turned)
    return F.when((F.lit(rounds) > last) | (met >= blocks), block).otherwise(met)


class Cell:
    """The sources of a block and their shares of a shard's terms."""

    def __init__(self, payload: bytes | None, sources: list[int], totals: list[int], width: int, terms: int):
        self.sources = np.array(sources, np.int64)
        self.counts = np.zeros((len(sources), width), np.int64)
        if payload is not None:
            source, place, n = unpack_arrays(payload)
            self.counts[np.searchsorted(self.sources, source), place] = n
        self.shares = shares(self.counts, np.array(totals, np.int64)[:, None], terms)


def _meetings(x: Cell, y: Cell, same: bool) -> list[tuple[int, int, int]]:
    """(a, b, value) for each source of x with each of y; within one block, each two once."""
    out = []
    for i, a in enumerate(x.sources.tolist()):
        values = divergence(x.shares[i], y.shares[i + 1 :] if same else y.shares).sum(axis=1, dtype=np.int64).tolist()
        out += [(a, b, v) for b, v in zip(y.sources[i + 1 :].tolist() if same else y.sources.tolist(), values)]
    return out


def _best_terms(x: Cell, terms: list[str], totals: list[int], whole: int, kept: int, top: int) -> list[tuple[int, str, int]]:
    """(source, term, value) of the terms of which a source has the largest excess over its language; terms ascend."""
    q = shares(np.array(totals, np.int64), np.array(whole, np.int64), kept)
    out = []
    for i, source in enumerate(x.sources.tolist()):
        places = np.flatnonzero((x.counts[i] > 0) & (x.shares[i] > q))
        values = divergence(x.shares[i][places], q[places])
        best = heapq.nsmallest(top, zip((-values).tolist(), places.tolist()))
        out += [(source, terms[place], -v) for v, place in best]
    return out


def _batch(lang: str, pairs: list[tuple[int, int, int]], best: list[tuple[int, str, int]] = ()) -> pa.RecordBatch:
    """Rows of MET: a pair in both directions; a term has no b."""
    rows = [(a, b, None, v) for a, b, v in pairs] + [(b, a, None, v) for a, b, v in pairs] + [(a, None, t, v) for a, t, v in best]
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64())))], ["lang", "a", "b", "term", "value"])


def resident_cells(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame, int, list[DataFrame]]:
    """Cells, dictionaries of shards, sources with their numbers, the number of rounds, and tables to delete afterwards."""
    kept = materialize(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    sources = counts.where("term is null").select("lang", "source")
    sources = materialize(sources.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "sources")
    most = (sources.agg(F.max("id")).first()[0] or 0) + 1
    each = -(-most // MOST_BLOCKS)  # sources in a block
    width = max(1, min(SHARD_TERMS, CELL // each))

    langs = sources.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole")), "lang", "left")
    langs = langs.select("lang", F.ceil(F.col("sources") / each).alias("blocks"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("whole", F.lit(0)).alias("whole"))
    langs = materialize(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / width))), "languages")
    lists = kept.join(langs.select("lang", "shards"), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"))
    lists = materialize(lists.agg(F.sort_array(F.collect_list(F.struct("term", "total"))).alias("list")), "dictionaries")
    dictionaries = langs.select("lang", "blocks", "terms", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).join(lists, ["lang", "shard"], "left")
    dictionaries = materialize(dictionaries.withColumn("list", F.coalesce("list", F.array().cast(lists.schema["list"].dataType))), "shards")

    places = lists.select("lang", "shard", F.posexplode("list").alias("place", "entry")).select("lang", F.col("entry.term").alias("term"), "shard", "place")
    hits = counts.where("term is not null").join(places, ["lang", "term"]).join(sources, ["lang", "source"]).select("lang", "shard", (F.col("id") / each).cast("long").alias("block"), "id", "place", "n")
    hits = materialize(hits, "placed-counts")

    def pack(keys: tuple, table: pa.Table) -> pa.Table:
        vectors = pack_arrays(*(table.column(c).to_numpy().astype(k) for c, k in (("id", "<i8"), ("place", "<i4"), ("n", "<i8"))))
        return pa.table({"lang": [keys[0].as_py()], "shard": [keys[1].as_py()], "block": [keys[2].as_py()], "payload": pa.array([vectors], pa.binary())})

    packed = hits.groupBy("lang", "shard", "block").applyInArrow(pack, "lang string, shard long, block long, payload binary")
    members = sources.join(hits.groupBy("lang", "id").agg(F.sum("n").alias("total")), ["lang", "id"], "left").groupBy("lang", (F.col("id") / each).cast("long").alias("block"))
    members = members.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("total", F.lit(0)).alias("total")))).alias("members"))
    members = members.select("lang", "block", F.col("members.id").alias("ids"), F.col("members.total").alias("totals"))
    shards = dictionaries.select("lang", "shard", "blocks", "terms", F.size("list").alias("width"))
    cells = materialize(members.join(shards, "lang").join(packed, ["lang", "shard", "block"], "left"), "resident-cells")
    return cells, dictionaries, sources, -(-most // each), [kept, langs, lists, hits]


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: each other source of the language with the divergence of the two term distributions; part term: the `top` terms that most
    set the source apart from its whole language.
    """
    spark = docs.sparkSession
    counts = materialize(tallies(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    cells, dictionaries, sources, blocks, scratch = resident_cells(counts, least_docs)
    residents = cells.repartition(parallelism(spark), "lang", "shard", "block").persist(StorageLevel.DISK_ONLY)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = Cell(r["payload"], r["ids"], r["totals"], r["width"], r["terms"])
                best = _best_terms(x, [e["term"] for e in r["list"]], [e["total"] for e in r["list"]], r["whole"], r["terms"], top)
                yield _batch(r["lang"], _meetings(x, x, True), best)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = Cell(r["payload"], r["ids"], r["totals"], r["width"], r["terms"])
                y = Cell(r["guest_payload"], r["guest_ids"], r["guest_totals"], r["width"], r["terms"])
                yield _batch(r["lang"], _meetings(x, y, False))

    def added(met: DataFrame) -> DataFrame:
        return met.groupBy("lang", "a", "b", "term").agg(F.sum("value").alias("value"))

    lists = dictionaries.select("lang", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "whole", "list")
    rounds = [materialize(added(residents.join(lists.hint("merge"), ["lang", "shard", "block"]).drop("block", "blocks").mapInArrow(own, MET)), "round-0")]
    for r in range(1, blocks + blocks % 2):
        host = partner(F.col("block"), r, F.col("blocks"))
        guests = cells.withColumn("host", host).where("host < block").select("lang", "shard", F.col("host").alias("block"), *(F.col(c).alias(f"guest_{c}") for c in ("ids", "totals", "payload")))
        met = residents.join(guests.hint("merge"), ["lang", "shard", "block"])
        met = met.select("lang", "ids", "totals", "payload", "width", "terms", "guest_ids", "guest_totals", "guest_payload").mapInArrow(meet, MET)
        rounds.append(materialize(added(met), f"round-{r}"))
    residents.unpersist()
    release(counts, cells, dictionaries, *scratch)

    met = reduce(DataFrame.unionByName, rounds)
    name = lambda key, out: sources.select("lang", F.col("id").alias(key), F.col("source").alias(out))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = met.where("term is null").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    terms = met.where("term is not null").join(name("a", "source"), ["lang", "a"]).withColumnRenamed("term", "item")
    pairs, terms = (x.select("lang", "source", F.lit(p).alias("part"), "item", "value", ranked.alias("rank")) for x, p in ((pairs, "pair"), (terms, "term")))
    return pairs.unionByName(terms.where(F.col("rank") <= top))
