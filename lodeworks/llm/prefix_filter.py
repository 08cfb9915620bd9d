"""All pairs of documents with similar shingle sets, by a prefix filter and verification.

In any order of the shingles that is the same for all documents, two sets whose Jaccard similarity is s or more
share a shingle among the first n - ceil(s n) + 1 of each (n: the set's size).  Only these prefixes meet, by
shingle.  Rare shingles come first: the order is by counters of fixed number, then by hash, so that a passage
that many documents hold is in few prefixes.  A counter sees all shingles of its slot; any counts give a right
result, a shingle that holds more than a slot's share of the corpus stands out.

Round one.  Documents that share a prefix shingle are a run.  Short runs give all their pairs; a longer run gives a
chain by set size and a star around the document that has the fewest rarer shingles, which is what the others are copies of, if it is
there; its rows are kept.  Pairs whose sizes and places in the
prefixes do not allow the similarity are left out (the first shingle that a similar pair shares always allows it).  These
pairs, and candidates found elsewhere, are verified; what is similar forms groups.

Round two.  Rows of the longer runs meet again with their groups and parities.  Runs within one group are done; in the others,
pairs of different groups are tested.  So a large group of copies costs links in proportion to its size, and no similar pair
of different groups is missed.

Verification.  A document's parities are bits, each the parity of the number of its shingles that fall there.  Two sets
differ in as many shingles at least as their parities differ in bits, so parities, which are 1/64 of the sets, rule out most pairs
without any error; whole sets decide the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import by_bucket, concat_packed, materialize, mix64, pack_arrays, release, split_by, unpack_arrays
from lodeworks.llm.components import connected_components
from lodeworks.llm.shingles import shingle_sets

SLOTS, PARTS = 1 << 20, 16
BATCH_ROWS = 500_000
BUCKET_BYTES = 16 << 20  # of text for each bucket of prefixes
#: Shorter runs of one shingle give all their pairs at once.
SHORT_RUN = 8
#: Pairs written at once.
PAIRS = 1 << 20
ROWS = "<u8 <i8 <i8 <i8"  # shingle, document, size of the set, place in its order
MET = "u long, v long, shingle long, size long, place long"  # a pair u, v; or a row of a longer run: u, its document
SLACK = 1e-9  # for rounding, on the side of more candidates


def shingle_ranks(docs: DataFrame, words: int) -> np.ndarray:
    """For each slot, 8 times the binary logarithm of its number of (document, shingle) pairs: SLOTS bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for piece in slices(batch):
                sets = list(shingle_sets(piece.column("text"), words))
                total += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([pack_arrays(x.astype(np.uint32)) for x in np.split(total, PARTS)], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PARTS, np.int64)
        for value in table.column("counts").to_pylist():
            total += unpack_arrays(value)[0]
        return pa.table({"part": table.column("part")[:1], "ranks": pa.array([np.floor(8 * np.log2(np.maximum(total, 1))).clip(0, 255).astype(np.uint8).tobytes()], pa.binary())})

    ranks = np.zeros(SLOTS, np.uint8)
    for r in docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, ranks binary").collect():  # one byte a slot
        ranks[r["part"] * (SLOTS // PARTS) : (r["part"] + 1) * (SLOTS // PARTS)] = np.frombuffer(r["ranks"], np.uint8)
    return ranks


def prefix_of(shingles: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a sorted set of shingles."""
    n = len(shingles)
    return shingles[np.argsort(ranks[(shingles % np.uint64(SLOTS)).astype(np.int64)], kind="stable")[: n - math.ceil(similarity * n - SLACK) + 1]]


def may_be_similar(size: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows a and b of one run can be of similar sets, if this is the first shingle that they share."""
    both = np.minimum(size[a] - place[a], size[b] - place[b])
    return both + SLACK >= similarity * (size[a] + size[b] - both)


def _runs(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs of a sorted column."""
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(shingle))


def first_pairs(shingle: np.ndarray, doc: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of round one (a pair may come several times), and which rows are of longer runs."""
    order = np.lexsort((doc, size, shingle))
    s, size, place = shingle[order], size[order], place[order]
    first, length = _runs(s)
    out = []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        near = may_be_similar(size, place, a, b, similarity)
        out.append((doc[order[a[near]]], doc[order[b[near]]]))

    for few in (True, False):
        runs = (length > 1) & ((length <= SHORT_RUN) == few)
        at, n = first[runs], length[runs]
        rows = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ahead = np.repeat(at + n, n) - rows  # rows of the run from this one on
        if few:
            for d in range(1, SHORT_RUN):
                rows, ahead = rows[ahead > d], ahead[ahead > d]
                take(rows, rows + d)
        elif len(rows):
            take(rows[ahead > 1], rows[ahead > 1] + 1)
            centre = at + np.array([np.lexsort((doc[order[a : a + m]], place[a : a + m]))[0] for a, m in zip(at.tolist(), n.tolist())])
            centre = np.repeat(centre, n)
            take(rows[rows != centre], centre[rows != centre])
            return out, order[rows]
    return out, order[:0]


def cross_pairs(shingle: np.ndarray, doc: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, parities: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of round two: of different groups, in one run, not ruled out by places and parities."""
    order = np.lexsort((group, shingle))
    shingle, doc, group, size, place = (x[order] for x in (shingle, doc, group, size, place))
    for begin, n in zip(*(x.tolist() for x in _runs(shingle))):
        bits = [np.frombuffer(parities[k], np.uint64) for k in order[begin : begin + n].tolist()]
        words = min(map(len, bits))
        bits = np.stack([fold(b, words) for b in bits])
        ends = begin + np.append(np.flatnonzero(np.diff(group[begin : begin + n])) + 1, n)
        a = begin
        for end in ends[:-1].tolist():
            few = np.arange(a, end)
            step = max(1, PAIRS // (len(few) * words))
            for low in range(end, begin + n, step):
                x, y = (v.ravel() for v in np.meshgrid(few, np.arange(low, min(low + step, begin + n))))
                near = may_be_similar(size, place, x, y, similarity)
                x, y = x[near], y[near]
                near = allowed(size[x], size[y], np.bitwise_count(bits[x - begin] ^ bits[y - begin]).sum(axis=1, dtype=np.int64), similarity)
                if near.any():
                    yield doc[x[near]], doc[y[near]]
            a = end


MOST_PARITIES = 1 << 14


def parities_of(shingles: np.ndarray) -> bytes:
    """A power of two of bits, about twice as many as shingles: 64 at least, MOST_PARITIES at most."""
    bits = min(MOST_PARITIES, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((mix64(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(parities: np.ndarray, words: int) -> np.ndarray:
    """Parities (uint64 words) as fewer words."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def allowed(size_a, size_b, differ, similarity: float):
    """Whether sets of these sizes that differ in so many shingles at least can be similar."""
    both = (size_a + size_b - differ) / 2
    return both + SLACK >= similarity * (size_a + size_b - both)


def not_ruled_out(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and parities allow the similarity; sketches: doc_id, size, parities."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (m, n, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size_u", "size_v", "parities_u", "parities_v")))):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                words = min(len(x), len(y))
                if allowed(m, n, int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()), similarity):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    side = lambda name: sketches.select(F.col("doc_id").alias(f"id_{name}"), F.col("size").alias(f"size_{name}"), F.col("parities").alias(f"parities_{name}"))
    both = pairs.join(side("u"), F.col("u") == F.col("id_u")).join(side("v"), F.col("v") == F.col("id_v"))
    return both.select("u", "v", "size_u", "size_v", "parities_u", "parities_v").mapInArrow(test, "u long, v long")


def verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v: doc_ids) whose shingle sets are similar; two empty sets are."""
    asked = pairs.select(F.col("u").alias("asked")).union(pairs.select("v")).distinct()

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(piece.column("text"), words)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    sets = materialize(docs.join(asked, F.col("doc_id") == F.col("asked"), "left_semi").mapInArrow(shingle, "id long, shingles binary"), "asked-sets", "lz4")
    left = pairs.join(sets.select(F.col("id").alias("i"), F.col("shingles").alias("a")), F.col("u") == F.col("i")).select("u", "v", "a")
    return left.join(sets.select(F.col("id").alias("i"), F.col("shingles").alias("b")), F.col("v") == F.col("i")).select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def _pair_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct pairs, as rows of MET."""
    x, y = (np.concatenate(c) for c in zip(*held))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(pairs.shape[1], pa.int64()) for _ in range(3))], ["u", "v", "shingle", "size", "place"])


def similar_groups(docs: DataFrame, sketches: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, root: components of all pairs with similar shingle sets.

    docs: doc_id (not null) and text; sketches: doc_id, size, parities of each document; candidates: pairs (u, v) found elsewhere.
    """
    buckets = max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    ranks = shingle_ranks(docs, words)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        parts = [(b, pack_arrays(*part)) for b, part in split_by((mix64(columns[0]) % np.uint64(buckets)).astype(np.int64), *columns)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["bucket", "payload"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in slices(batch):
                for doc, s in zip(piece.column("doc_id").to_pylist(), shingle_sets(piece.column("text"), words)):
                    if len(s):
                        prefix = prefix_of(s, ranks, similarity)
                        n = len(prefix)
                        held.append((prefix, np.full(n, doc, np.int64), np.full(n, len(s), np.int64), np.arange(n, dtype=np.int64)))
                        rows += n
                        if rows >= BATCH_ROWS:
                            yield packed(held)
                            held, rows = [], 0
        if held:
            yield packed(held)

    def meet(table: pa.Table) -> pa.Table:
        shingle, doc, size, place = concat_packed(table.column("payload").to_pylist(), ROWS)
        pairs, longer = first_pairs(shingle, doc, size, place, similarity)
        rows = pa.RecordBatch.from_arrays([pa.array(doc[longer]), pa.nulls(len(longer), pa.int64()), pa.array(shingle[longer].view(np.int64)), pa.array(size[longer]), pa.array(place[longer])], ["u", "v", "shingle", "size", "place"])
        return pa.Table.from_batches([rows, *([_pair_batch(pairs)] if pairs else [])])

    def cross(table: pa.Table) -> pa.Table:
        columns = [*(table.column(c).to_numpy() for c in ("shingle", "u", "known", "size", "place")), table.column("parities").to_pylist()]
        found, held, rows = [], [], 0
        for x, y in cross_pairs(*columns, similarity):
            held.append((x, y))
            rows += len(x)
            if rows >= PAIRS:
                found.append(_pair_batch(held))
                held, rows = [], 0
        if held:
            found.append(_pair_batch(held))
        return pa.Table.from_batches(found).select(["u", "v"]) if found else pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    met = materialize(by_bucket(docs.mapInArrow(prefixes, "bucket int, payload binary"), buckets, meet, MET), "prefix-runs")
    pairs = materialize(met.where("v is not null").select("u", "v").unionByName(candidates).where("u <> v").distinct(), "candidate-pairs")
    possible = materialize(not_ruled_out(pairs, sketches, similarity), "possible-pairs")
    links = materialize(verified(docs, possible, words, similarity), "similar-pairs")
    groups = materialize(connected_components(links, "similar-components"), "similar-groups")
    release(pairs, possible, links)

    rows = met.where("v is null").join(groups, F.col("u") == F.col("node"), "left").select("u", "shingle", F.coalesce("root", "u").alias("known"), "size", "place")
    rows = materialize(rows, "longer-runs")
    release(met)
    mixed = materialize(rows.groupBy(F.col("shingle").alias("s")).agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("s"), "mixed-runs")
    rest = rows.join(mixed, F.col("shingle") == F.col("s"), "left_semi").join(sketches.select("doc_id", "parities"), F.col("u") == F.col("doc_id"))
    rest = rest.select(F.pmod(F.xxhash64("shingle"), F.lit(buckets)).cast("int").alias("bucket"), "u", "shingle", "known", "size", "place", "parities")
    more = materialize(by_bucket(rest, buckets, cross, "u long, v long").distinct(), "cross-pairs")
    release(rows, mixed)
    if more.isEmpty():
        return groups
    known = groups.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return connected_components(known.unionByName(verified(docs, more, words, similarity)), "all-components")
