"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints.  A text's words (lower-cased A-Z) form shingles; bit i of its 64-bit fingerprint is 1 if
bit i is set in over half of the shingles' XXH64 hashes.

Keys.  The fingerprint is cut into segments of at most 23 bits.  The binary Golay code [23, 12] is
perfect: every 23-bit word has one codeword within 3 bits; a word at distance 3 from it has 5 more
codewords at distance 4.  Two words that differ in 2 bits or fewer have a word between them, whose
codeword is within 4 bits of both - so if a word is decoded to all its codewords within 4 bits (1 or
6), such a pair shares an index.  Up to 4 bits over 3 segments (of 22, 21 and 21 bits): the two segments with the
fewest errors have 0 and at most 2, or 1 and 1, and then the third has at most 2.  The keys are
therefore, of 34 bits each: a segment as it is with an index of another; and an index of a segment with a half
of each other one, of which one half is without error.  That makes about 96 keys, and two fingerprints that have nothing to
do with each other meet once in 30 million pairs.  For more bits the keys are the index pairs of
all pairs of segments, of 24 bits, about 28 for each pair: of n segments, two have 2 errors or fewer each as long
as at most 3 (n - 1) - 1 bits differ.

Join and verify.  Keys travel in packed arrays to key buckets; equal keys are compared there, and
pairs within the permitted distance are links.  Exact copies have travelled as one fingerprint.  A
bucket reports a spanning forest of its links, never all pairs of a dense group; a run of many equal
keys is searched breadth-first in numpy blocks.  Components of the forests, by rounds of large-star
and small-star, are the components of all links.

Defined cases: null text equals empty text, whose fingerprint is zero and linked like any other; a
text of fewer words than a shingle is one shingle; a null doc_id is never a component's name unless
the component has no other; rows with one doc_id are reported each; an empty table gives an empty result;
other columns are ignored.  A text is hashed in stretches, so its length is bounded only by a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import by_bucket, id_and_text, materialize, mix64
from lodeworks.llm.components import connected_components, local_forest
from lodeworks.llm.prefix_filter import parities_of, similar_groups
from lodeworks.llm.shingles import shingle_and_word_sets

SHINGLE, MAX_BITS, SEED = 4, 4, 42
STRETCH = 1 << 16
#: Up to so many bits, keys are long (34 bits).
LONG_KEY_BITS = 4
#: Keys of a bucket, about.
BUCKET_KEYS = 1_000_000
#: Longer runs of equal keys are searched breadth-first instead of pair by pair.
SHORT_RUN = 32
GENERATOR = 0b110001110101  # of the cyclic Golay code


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    body, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(body, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(tokens) - words])]
    return np.array([digest(body[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), STRETCH):
        counts += np.unpackbits(hashes[a : a + STRETCH].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(shingle_hashes(t, words))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the lightest word (weight 3 at most), its weight, the five words of weight 4 if that is 3."""
    syndrome_of_bit = []
    for bit in range(23):
        x = 1 << bit
        for high in range(bit, 10, -1):
            if x >> high & 1:
                x ^= GENERATOR << (high - 11)
        syndrome_of_bit.append(x)
    leader, weight, fours = np.zeros(2048, np.int64), np.full(2048, 9), np.zeros((2048, 5), np.int64)
    filled = [0] * 2048
    for w in range(5):
        for bits in itertools.combinations(range(23), w):
            s = word = 0
            for bit in bits:
                s ^= syndrome_of_bit[bit]
                word |= 1 << bit
            if weight[s] > w:
                leader[s], weight[s] = word, w
            elif w == 4 and weight[s] == 3:
                fours[s, filled[s]] = word
                filled[s] += 1
    return leader, weight, fours


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Of the low 12 and the high 11 bits of a word."""
    def of(x: int) -> int:
        for high in range(22, 10, -1):
            if x >> high & 1:
                x ^= GENERATOR << (high - 11)
        return x

    return np.array([of(x) for x in range(1 << 12)]), np.array([of(x << 12) for x in range(1 << 11)])


def codeword_indices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of at most 23 bits: (n, 6) indices of the codewords within 4 bits, and which of them hold."""
    leader, weight, fours = golay_tables()
    low, high = _syndromes()
    s = low[values & 0xFFF] ^ high[values >> 12]
    words = np.concatenate([(values ^ leader[s])[:, None], values[:, None] ^ fours[s]], axis=1)
    holds = np.ones(words.shape, bool)
    holds[:, 1:] = (weight[s] == 3)[:, None]
    return words >> 11, holds


def segment_widths(max_bits: int) -> list[int]:
    n = max(3, max_bits // 3 + 2)
    return [64 // n + (i < 64 % n) for i in range(n)]


def golay_keys(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """keys and, for each, the position of its fingerprint in fps."""
    at, values, indices = 0, [], []
    widths = segment_widths(max_bits)
    for width in widths:
        values.append(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        indices.append(codeword_indices(values[-1]))
        at += width
    keys, owners = [], []

    def take(rest: np.ndarray, index: np.ndarray, holds: np.ndarray) -> None:
        key = (rest << 12) | index | (len(keys) << 40)
        keys.append(key[holds])
        owners.append(np.nonzero(holds)[0])

    if max_bits <= LONG_KEY_BITS:
        halves = [(v & ((1 << w // 2) - 1), v >> w // 2) for v, w in zip(values, widths)]
        for i, j in itertools.permutations(range(3), 2):
            take(values[i][:, None], *indices[j])
        for c, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
            for x, y in itertools.product(halves[a], halves[b]):
                take(((x << 11) | y)[:, None], *indices[c])
    else:
        for (a, holds_a), (b, holds_b) in itertools.combinations(indices, 2):
            take(a[:, :, None], b[:, None, :], holds_a[:, :, None] & holds_b[:, None, :])
    return np.concatenate(keys).astype(np.uint64), np.concatenate(owners)


def keys_each(max_bits: int) -> int:
    """Keys of a fingerprint, about."""
    n = len(segment_widths(max_bits))
    return 96 if max_bits <= LONG_KEY_BITS else 28 * n * (n - 1) // 2


def _dense_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps, breadth-first."""
    rest, parents, children = np.arange(len(fps)), [], []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            block, frontier = frontier[:512], frontier[512:]
            reached, by = np.zeros(len(rest), bool), np.zeros(len(rest), np.int64)
            step = max(1, (1 << 21) // len(block))
            for a in range(0, len(rest), step):
                near = np.bitwise_count(fps[block][:, None] ^ fps[rest[a : a + step]][None, :]) <= max_bits
                reached[a : a + step], by[a : a + step] = near.any(axis=0), near.argmax(axis=0)
            parents.append(block[by[reached]])
            children.append(rest[reached])
            frontier, rest = np.concatenate([frontier, rest[reached]]), rest[~reached]
    if not parents:
        return np.zeros(0, fps.dtype), np.zeros(0, fps.dtype)
    return fps[np.concatenate(parents)], fps[np.concatenate(children)]


def links_in_bucket(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    lengths = np.diff(starts, append=len(keys))
    left, right = [], []
    for a, n in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
        x, y = _dense_links(np.unique(fps[a : a + n]), max_bits)
        left.append(x)
        right.append(y)
    run = (lengths > 1) & (lengths <= SHORT_RUN)
    starts, lengths = starts[run], lengths[run]
    rows = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    ahead = np.repeat(starts + lengths, lengths) - rows  # rows of the run from this one on
    for d in range(1, SHORT_RUN):
        rows, ahead = rows[ahead > d], ahead[ahead > d]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + d]) <= max_bits]
        left.append(fps[near])
        right.append(fps[near + d])
    if not left:
        return fps[:0], fps[:0]
    return local_forest(np.concatenate(left), np.concatenate(right))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps (fp, distinct) -> u, v: a forest of links with the components of all links."""
    buckets = max(8, -(-fps.count() * keys_each(max_bits) // BUCKET_KEYS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(values), 8192):
                part = values[a : a + 8192]
                keys, owners = golay_keys(part, max_bits)
                mixed = mix64(keys)
                bucket, keys = (mixed % np.uint64(buckets)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.uint32)  # within a bucket 32 bits tell keys apart well enough
                order = np.argsort(bucket, kind="stable")
                keys, owned, bucket = keys[order], part[owners[order]], bucket[order]
                names, starts = np.unique(bucket, return_index=True)
                ends = np.append(starts[1:], len(bucket)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([keys[s:e].tobytes() for s, e in zip(starts.tolist(), ends)], pa.binary()), pa.array([owned[s:e].tobytes() for s, e in zip(starts.tolist(), ends)], pa.binary())], ["bucket", "keys", "fps"])

    def match(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        values = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
        u, v = links_in_bucket(keys, values, max_bits)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return by_bucket(fps.select("fp").mapInArrow(spread, "bucket int, keys binary, fps binary"), buckets, match, "u long, v long")


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints (doc_id, fp; materialised) with component_id."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = connected_components(fingerprint_links(classes, max_bits), "fingerprint-links")
    linked = roots.select(F.col("node").alias("n"), "root").unionByName(roots.select(F.col("root").alias("n"), "root").distinct())
    named = classes.join(linked, F.col("fp") == F.col("n"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "fingerprint-names")  # written: AQE can split the join below where a component is large
    named = named.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    found = fingerprint_components(prints, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_set_sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp, size, parities: the fingerprint of the text's distinct words, which moves by few bits when a few words change; the shingle set's size and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = [(_signed(fingerprint(np.unique(w))), len(s), parities_of(s)) for s, w in shingle_and_word_sets(piece.column("text"), words)]
                fps, sizes, parities = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary())], ["doc_id", "fp", "size", "parities"])

    return docs.mapInArrow(run, "doc_id long, fp long, size long, parities binary")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id of the documents that are near copies: their shingle sets' Jaccard similarity is verified.

    Candidates are the links of fingerprints of the distinct words (in each group of linked fingerprints, a star) and,
    for what these miss, those of a prefix filter, which misses no pair.  A group is a component of verified
    pairs, and its smallest doc_id stays.  Texts without words are alike.  Rows without doc_id are nobody's copy; rows with one
    doc_id are one document.  An empty table gives an empty result; other columns are ignored.
    """
    docs = id_and_text(docs).where(F.col("doc_id").isNotNull())
    prints = materialize(word_set_sketches(docs, words), "word-sketches")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "word-classes")
    links = fingerprint_links(classes, max_bits)
    named = links.join(classes.select(F.col("fp").alias("f"), F.col("least").alias("a")), F.col("u") == F.col("f")).select("a", "v")
    named = named.join(classes.select(F.col("fp").alias("f"), F.col("least").alias("b")), F.col("v") == F.col("f")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    same = prints.join(classes.select(F.col("fp").alias("f"), "least"), F.col("fp") == F.col("f")).where("doc_id <> least").select(F.col("least").alias("u"), F.col("doc_id").alias("v"))
    roots = similar_groups(docs, prints.select("doc_id", "size", "parities"), named.unionByName(same), words, similarity)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))
