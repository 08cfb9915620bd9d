"""Token-id output in patched frame-of-reference blocks.

A segment is one binary value; a dataset is a Parquet folder with a row for each segment, so that
Spark's writers commit it and any store that Spark reaches can hold it:

    shard, start_in_shard   where the segment's first id lies: the shard (a range of doc_ids) and the ids before it there
    n_ids, doc_ids, lengths the documents of the segment, whole, in ascending doc_id order, and their ids each
    payload                 header, block index, packed blocks, exceptions (below)

Payload, little-endian: magic "PFB1", n_ids u32, n_blocks u32; for each block its minimum u32, width
u8, exceptions u16 and the start of its packed bits u32 (the block index); the packed bits; then all
exceptions, a position u16 and a value u32 each.  A block has 512 ids.  Its minimum is subtracted, the
width is that of the given percentile of the differences, and ids that need more bits are stored in
the exception list instead.  One block can be read alone by its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import load, slices, with_end
from lodeworks.llm.common import id_and_text, parallelism, shared_root

BLOCK = 512
PERCENTILE = 95
SEGMENT_IDS = 1 << 18
SHARD_BYTES = 128 << 20
MAGIC = b"PFB1"
SEGMENTS = "shard int, start_in_shard long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
INDEX = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u4")])
EXCEPTION = np.dtype([("position", "<u2"), ("value", "<u4")])


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros((n_blocks, BLOCK), np.uint32)
    grid.reshape(-1)[:n] = ids
    if n % BLOCK:
        grid[-1, n % BLOCK :] = ids[-1]
    minimum = grid.min(axis=1) if n else np.zeros(0, np.uint32)
    grid -= minimum[:, None]
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # the bit length of each difference
    kth = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.maximum(np.partition(bits, kth, axis=1)[:, kth], 1) if n else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    at = np.nonzero(over)
    listed = np.zeros(len(at[0]), EXCEPTION)
    listed["position"], listed["value"] = at[1], grid[at]
    grid[at] = 0
    size = width.astype(np.int64) * (BLOCK // 8)
    index = np.zeros(n_blocks, INDEX)
    index["minimum"], index["width"], index["exceptions"], index["start"] = minimum, width, over.sum(axis=1), np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        kind = "<u2" if w <= 16 else "<u4"
        stream = np.unpackbits(grid[rows].astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
        body = np.packbits(stream.reshape(len(rows), -1), axis=1, bitorder="little")
        for row, start in zip(body, index["start"][rows].tolist()):
            packed[start : start + len(row)] = row
    return b"".join([MAGIC, np.array([n, n_blocks], "<u4").tobytes(), index.tobytes(), packed.tobytes(), listed.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a token block segment")
    n, n_blocks = np.frombuffer(payload, "<u4", 2, 4).tolist()
    index = np.frombuffer(payload, INDEX, n_blocks, 12)
    body = 12 + n_blocks * INDEX.itemsize
    width = index["width"].astype(np.int64)
    total = int(width.sum()) * (BLOCK // 8)
    packed = np.frombuffer(payload, np.uint8, total, body)
    grid = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        length, room = w * BLOCK // 8, 16 if w <= 16 else 32
        block = np.stack([packed[s : s + length] for s in index["start"][rows].tolist()])
        bits = np.zeros((len(rows), BLOCK, room), np.uint8)
        bits[:, :, :w] = np.unpackbits(block, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        grid[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u2" if room == 16 else "<u4")
    listed = np.frombuffer(payload, EXCEPTION, int(index["exceptions"].sum()), body + total)
    grid[np.repeat(np.arange(n_blocks), index["exceptions"]), listed["position"]] = listed["value"]
    grid += index["minimum"][:, None]
    return grid.reshape(-1)[:n]


def _segments(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, start = load(path), TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal start, held_ids, held_docs, held_counts, held
            ids = np.concatenate(held_ids)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held_docs], pa.list_(pa.int64())), pa.array([held_counts], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())], schema=SEGMENT_ARROW)
            start += len(ids)
            held_ids, held_docs, held_counts, held = [], [], [], 0
            return row

        for batch in batches:
            for part in slices(batch):
                flat, counts = with_end(*bpe.encode(part.column("text")), end_id)
                ends = np.cumsum(counts)
                docs, a = part.column("doc_id").to_pylist(), 0
                while a < len(docs):  # whole documents, until the segment is full
                    before = ends[a] - counts[a]
                    b = max(a + 1, int(np.searchsorted(ends, before + segment_ids - held, "right")))
                    held_ids.append(flat[before : ends[b - 1]])
                    held_docs += docs[a:b]
                    held_counts += counts[a:b].tolist()
                    held += int(ends[b - 1] - before)
                    a = b
                    if held >= segment_ids or a < len(docs):
                        yield flush()
        if held_docs:
            yield flush()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, docs, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "start_in_shard", "doc_ids", "lengths", "payload"))):
            body = memoryview(unpack(payload).astype("<u4").tobytes())
            starts = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + starts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS, shards: int | None = None) -> None:
    """Write every document's ids, an end id behind each, in ascending doc_id order (null first; rows of one doc_id by text).

    By default there is a shard for each SHARD_BYTES of text, and as many as the session runs at once at least.
    """
    if not shards:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(parallelism(docs.sparkSession), -(-n_bytes // SHARD_BYTES))
    # Ranges of the id alone: their bounds come from a sample of keys at the driver.
    ordered = id_and_text(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer_path, end_id, segment_ids), SEGMENTS).write.option("compression", "none").parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    base = sizes.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    found = segments.mapInArrow(_documents, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # The number of shards is that of the write's partitions: a bounded side.
    return found.join(F.broadcast(base), F.col("shard") == F.col("s")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write docs to path (by default a new folder among the shared ones), read the files back."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer_path, **options)
    return read_token_blocks(spark, path)
