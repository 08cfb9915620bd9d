"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition turns its documents into (digest, best row) entries.  The runs are then
exchanged in rounds: in round r a run's holder passes each entry to the holder whose r-th digit is
the entry's r-th digest digit (a binomial exchange, generalised from radix 2 to radix R so that two
or three rounds serve thousands of partitions).  Within a round each partition merges the sorted
runs that it received and keeps, for every digest, one entry: the row that stays so far and the
number of rows behind it.  Hot groups therefore shrink at every level, first inside the partition
that read them, and no task ever holds more than its share of the digest space.

Equality is verified at each merge: entries are equal only if the SHA-256, an independent 64-bit
hash and the byte length of the normalised text all agree.

Defined cases: null text equals empty text; texts equal after deleting ``[\\x20\\x09-\\x0D]`` form a
group; the longest original text (in code points), then the smallest doc_id stays; null doc_ids sort
last and never win over a number; rows repeating one doc_id with one text are each reported (the
doc_id is what is kept), unless a column that numbers the rows is named: then exactly one row of each group
is kept, also where ids repeat or are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import materialize, parallelism

SPACE = b" \t\n\x0b\x0c\r"
NO_ID = np.iinfo(np.int64).max
DIGESTS = "doc_id long, row long, n_chars int, digest binary, verify long, n_bytes long"
ENTRIES = "slot int, digest binary, verify long, n_bytes long, n_chars int, keep_id long, keep_row long, group_size long"
ENTRY_ARROW = pa.schema([("slot", pa.int32()), ("digest", pa.binary()), ("verify", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int32()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_chars, digest, verify, n_bytes = [], [], [], []
        for text in batch.column("text").to_pylist():
            body = text.encode().translate(None, SPACE)
            n_chars.append(len(text))
            digest.append(hashlib.sha256(body).digest())
            verify.append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
            n_bytes.append(len(body))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n_chars, pa.int32()), pa.array(digest, pa.binary()), pa.array(verify, pa.int64()), pa.array(n_bytes, pa.int64())], ["doc_id", "row", "n_chars", "digest", "verify", "n_bytes"])


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    ids = table.column("keep_id").fill_null(NO_ID).to_numpy()
    digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), dtype=">u8").reshape(-1, 4).astype(np.uint64)
    return {"digest": digest, "keep_id": ids} | {k: table.column(k).to_numpy() for k in ("slot", "verify", "n_bytes", "n_chars", "keep_row", "group_size")}


def _fold(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One entry for each digest: c's rows are brought into order, the first of each group stays."""
    d = c["digest"]
    order = np.lexsort((c["keep_row"], c["keep_id"], -c["n_chars"].astype(np.int64), c["n_bytes"], c["verify"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    c = {k: v[order] for k, v in c.items()}
    d = c["digest"]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1) | (c["verify"][1:] != c["verify"][:-1]) | (c["n_bytes"][1:] != c["n_bytes"][:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(c["group_size"], first)
    return {k: v[first] for k, v in c.items()} | {"group_size": size}


def _batch(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    raw = c["digest"].astype(">u8").tobytes()
    digest = [raw[i : i + 32] for i in range(0, len(raw), 32)]
    return pa.RecordBatch.from_arrays([pa.array(c["slot"], pa.int32()), pa.array(digest, pa.binary()), *(pa.array(c[k], t) for k, t in (("verify", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int32()))), pa.array(c["keep_id"], pa.int64(), mask=c["keep_id"] == NO_ID), pa.array(c["keep_row"], pa.int64()), pa.array(c["group_size"], pa.int64())], schema=ENTRY_ARROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiway merge of a partition's runs, which arrive in digest order: a batch's last digest waits for the next batch."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = _columns(pa.Table.from_batches([batch]))
        if held is not None:
            c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
        c = _fold(c)
        held = {k: v[-1:] for k, v in c.items()}
        if len(c["slot"]) > 1:
            yield _batch({k: v[:-1] for k, v in c.items()})
    if held is not None:
        yield _batch(held)


def digest_table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """The digests of each row; row names the column that numbers the rows, if there is one."""
    number = F.col(row).cast("long") if row else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_digest, DIGESTS)


def _digit(column, r: int, radix: int):
    """The r-th digit of a digest, from bytes of its own."""
    return (F.conv(F.hex(F.substring(column, 1 + 4 * r, 4)), 16, 10).cast("long") % radix).cast("int")


def merge_runs(digests: DataFrame, radix: int | None = None, rounds: int = 2) -> DataFrame:
    """digest, verify, n_bytes -> n_chars, keep_id, keep_row, group_size: one row for each distinct text.

    radix ** rounds partitions hold the result; by default that is the session's parallelism or a
    little more.
    """
    spark = digests.sparkSession
    radix = radix or max(2, math.ceil(parallelism(spark) ** (1 / rounds)))
    runs = digests.select((F.spark_partition_id() % radix**rounds).alias("slot"), "digest", "verify", "n_bytes", "n_chars", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    runs = runs.sortWithinPartitions("digest").mapInArrow(_merge, ENTRIES)  # level 0: inside the partition that read the rows
    for r in range(rounds):
        place = radix**r
        kept_digits = F.col("slot") - (F.floor(F.col("slot") / place) % radix) * place
        runs = runs.withColumn("slot", (kept_digits + _digit(F.col("digest"), r, radix) * place).cast("int"))
        runs = runs.repartitionById(radix**rounds, F.col("slot")).sortWithinPartitions("digest").mapInArrow(_merge, ENTRIES)
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, radix: int | None = None, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with row (the name of a column that numbers the rows) also row."""
    digests = materialize(digest_table(docs, row), "digests")
    # Only texts that occur again travel back; all others are their own group.
    again = merge_runs(digests, radix).where("group_size > 1").select(F.col("digest").alias("d"), F.col("verify").alias("v"), F.col("n_bytes").alias("b"), "keep_id", "keep_row", "group_size")
    joined = digests.join(again, (F.col("digest") == F.col("d")) & (F.col("verify") == F.col("v")) & (F.col("n_bytes") == F.col("b")), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["row"] if row else []),
    )
