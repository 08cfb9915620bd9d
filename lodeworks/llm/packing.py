"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents (their ids and an end id) are cut into pieces of the sequence length and a last, shorter
piece.  The number of pieces of each length is all that packing looks at: a histogram of at most
``capacity`` rows, so the driver's work does not grow with the corpus.  Lengths are placed longest
first, each time onto the shortest packs that have room (a pack is a pattern of lengths with a
count), opening new packs when none has.  Then every piece is ranked among the pieces of its length
and takes the place that its rank has in the patterns.

Pieces are ranked within (length, bucket), buckets by a hash of the identifier, and bucket sizes are
summed up per length, so no length - a third of all pieces may be full sequences - is ranked in one
task.

Defined cases: null text is an empty document, whose only id is the end id; ties in length are
ordered by bucket, doc_id and start (pieces equal in all of these are alike, so either order will
do); a null doc_id sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import load, slices, with_end
from lodeworks.llm.common import id_and_text, materialize, parallelism

CAPACITY = 1024


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(count, lengths of the pattern) for all packs; every length of the histogram is in them."""
    open_packs: list[tuple[int, int, list[int]]] = []  # (fill, count, lengths), the shortest first
    done: list[tuple[int, list[int]]] = []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not open_packs or open_packs[0][0] + length > capacity:
                fill, count, lengths = 0, n, []
            else:
                fill, count, lengths = heapq.heappop(open_packs)
            used = min(n, count)
            if used < count:
                heapq.heappush(open_packs, (fill, count - used, lengths))
            pack = (fill + length, used, [*lengths, length])
            if pack[0] == capacity:
                done.append(pack[1:])
            else:
                heapq.heappush(open_packs, pack)
            n -= used
    return done + [p[1:] for p in open_packs]


BUCKET_PIECES = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                flat, counts = with_end(*bpe.encode(part.column("text")), end_id)
                body = memoryview(flat.astype("<u4").tobytes())
                n_pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                first = np.cumsum(n_pieces) - n_pieces
                start = (np.arange(len(doc)) - first[doc]) * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the documents' ids cut at multiples of capacity."""
    return id_and_text(docs).mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES)


class Places:
    """For each length, ranges of ranks and where they lie: sequence_id = base + rank - first rank."""

    SHIFT = 44  # ranks of one length stay below 2 ** SHIFT

    def __init__(self, packs: list[tuple[int, list[int]]]) -> None:
        taken: dict[int, int] = {}
        rows, base = [], 0
        for count, lengths in packs:
            offset = 0
            for length in lengths:
                rank = taken.get(length, 0)
                rows.append(((length << self.SHIFT) + rank, base - rank, offset))
                taken[length] = rank + count
                offset += length
            base += count
        self.keys, self.base, self.offset = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 3
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (length << self.SHIFT) + rank, "right") - 1
        return self.base[i] + rank, self.offset[i]


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset.  cut is read several times: materialise it before.

    Pieces of one length are ranked bucket by bucket; the buckets grow with their number, so that a task ranks BUCKET_PIECES at most.
    """
    buckets = max(64, parallelism(cut.sparkSession), -(-cut.count() // BUCKET_PIECES))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(shortest_pack_first(histogram, capacity))
    before = sizes.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = cut.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = inside.join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("inside") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = places.find(pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(materialize(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
