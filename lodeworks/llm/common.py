"""Helpers shared by the training-data operators: table access, shared folders, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.shared import materialize, release, shared_root  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and that column's name (one that docs does not have)."""
    name = "row_number"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


#: Tasks of a step that works bucket by bucket; with more buckets, a task has several, one after the other.
MOST_PARTITIONS = 50_000


def by_bucket(rows: DataFrame, buckets: int, work: Callable, schema: str) -> DataFrame:
    """work(table of one bucket's rows) -> table, for each value of the column bucket (0 to buckets - 1) that has rows.

    A partition for each bucket, up to MOST_PARTITIONS; a partition's rows are sorted by bucket (which spills), so
    a task holds one bucket at a time.
    """
    partitions = min(buckets, MOST_PARTITIONS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, current = [], None
        for batch in batches:
            names = batch.column("bucket").to_numpy()
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else names
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(names)]):
                if held and names[a] != current:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                current = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    dealt = rows.repartitionById(partitions, F.col("bucket") % F.lit(partitions))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, schema)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def binary_column(batch, name: str) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string or binary Arrow column and its offsets, without copying values."""
    import pyarrow as pa

    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    kind = col.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    buffers = col.buffers()
    if len(col) == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    return data, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary value."""
    import zstandard

    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack_arrays(value: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(","):
        kind, n = part.split(":")
        out.append(np.frombuffer(raw, np.dtype(kind), int(n), at))
        at += out[-1].nbytes
    return out


def concat_packed(values: list[bytes], kinds: str) -> list[np.ndarray]:
    """The arrays of several packed values, each joined; kinds are their types where there are no values."""
    if not values:
        return [np.zeros(0, k) for k in kinds.split()]
    return [np.concatenate(x) for x in zip(*map(unpack_arrays, values))]


def split_by(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, arrays of its rows) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, starts[1:])):
        yield name, [a[rows] for a in arrays]
