"""Suffix-array deduplication of long byte strings by a run-length index.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller
doc_id.  Indexing the whole corpus in one place is out of the question, so the index is made to see
repetitive text only, and in pieces:

1. Anchors.  Winnowing selects grams such that equal 50-byte strings select the same gram at the
   same place.  An anchor's context is all that a string which selects it may cover (34 bytes to the
   left, 50 from its start on).  Anchors travel packed, by gram hash: the hash, a hash of
   the context, hashes of the two halves around the gram, and the place.
2. Verdicts.  If the same context stands in a smaller document, all of it goes.  Anchors whose gram is
   repeated in other documents with other contexts are boundaries of repetitions: they are asked for.
3. Index.  The asked contexts, cut out of their documents, meet by gram hash.  In each bucket a
   run-compressed Burrows-Wheeler transform with sampled run ends is built over them, matching
   statistics are streamed along the text, and strings whose match is 50 bytes long or longer and whose
   group has a smaller document are marked.
4. Marks meet their documents again; covered bytes are cut out.

Hot groups.  Copies within a batch are settled by the task that reads them, so a context copied into a
third of all rows travels once a batch.  A gram with more than ``CROWD`` boundary contexts does not go to
an index bucket: its 50-byte strings are dealt out by their own hashes (128 bits), after the same combination.

Every repeated string selects an anchor in each document, whose context is covered, asked for or crowded,
so nothing is missed; contexts agree in a 64-bit and a gram hash, strings in 128 bits, before bytes are called equal.

Identity.  Each row gets a number of its own when the documents are written, compressed, at the start; anchors,
asks and marks carry that number and the doc_id, so no two rows are ever taken for one.  Buckets are partitions
up to MOST_PARTITIONS; beyond that a task sorts its rows by bucket and works on one bucket after the other.

Defined cases: null text is empty; documents shorter than 50 bytes stay whole; rows with one doc_id
never delete from each other, whatever their texts; a null doc_id counts as smaller than all others (as -2 ** 63
does); negative ids are ordered as numbers; an empty table gives an empty result; other columns are ignored; a
document of any length is read in overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import anchors as A
from lodeworks.llm.common import by_bucket, concat_packed, id_and_text, materialize, mix64, pack_arrays, split_by, unpack_arrays
from lodeworks.llm.run_index import RunIndex

LENGTH, GRAM = 50, 16
CROWD = 4096
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text for each anchor bucket
DOC_BUCKET_BYTES = 16 << 20
#: Kinds of rows that travel: anchors; marks; asked contexts; contexts of crowded grams; documents.
ANCHOR, MARK, ASK, CROWDED, DOCUMENT = range(5)
ROWS = "bucket int, kind int, payload binary"
CORPUS = "bucket int, number long, doc_id long, packed binary"
MARK_ARRAYS = "<u8 <i8 <i8"  # document number, start, end
NO_ID = np.iinfo(np.int64).min


def _row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "kind", "payload"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _bounds(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(new), np.cumsum(new) - 1


class Plan:
    """Sizes of a run: buckets of anchors, of index contexts and of documents."""

    def __init__(self, length: int, gram: int, n_bytes: int) -> None:
        self.length, self.gram, self.reach = length, gram, length - gram
        self.buckets = max(8, -(-n_bytes // BUCKET_BYTES))
        self.index_buckets = 4 * self.buckets
        self.doc_buckets = max(8, -(-n_bytes // DOC_BUCKET_BYTES))

    def doc_bucket(self, number: np.ndarray) -> np.ndarray:
        return (mix64(number) % np.uint64(self.doc_buckets)).astype(np.int64)

    def marks(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, bucket_of) -> list[tuple[int, int, bytes]]:
        """Rows of kind MARK for each document bucket."""
        start = np.maximum(start, 0)
        return [(bucket_of(b), MARK, pack_arrays(*part)) for b, part in split_by(self.doc_bucket(key), key, start, end)]


def _find_anchors(plan: Plan, keys: list[int], ids: list[int], texts: list[bytes]) -> list[np.ndarray]:
    """gram hash, context hash, left and right half hashes, document number, doc_id, position of all anchors."""
    out: list[list[np.ndarray]] = []

    def take(parts: list[bytes], key: list[int], doc: list[int], origin: int, low: int, high: int | None) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        at, gram, sums = A.anchors(data, starts, plan.length, plan.gram)
        if high is not None:
            use = (at >= low) & (at < high)
            at, gram = at[use], gram[use]
        which = np.searchsorted(starts, at, "right") - 1
        a, b = np.maximum(at - plan.reach, starts[which]), np.minimum(at + plan.length, starts[which + 1])
        context = A.mix(A.span_hash(sums, a, b) + (b - a).astype(np.uint64) * A.BASE + (at - a).astype(np.uint64), 0x94D049BB133111EB)
        left, right = np.maximum(at - plan.reach // 2, a), np.minimum(at + plan.gram + plan.reach // 2, b)
        halves = [A.mix(A.span_hash(sums, x, y) + (y - x).astype(np.uint64), 0x94D049BB133111EB).astype(np.uint16) for x, y in ((left, at), (at + plan.gram, right))]
        out.append([gram, context, *halves, np.array(key, np.uint64)[which], np.array(doc, np.int64)[which], at - starts[which] + origin])

    parts, key, doc, size = [], [], [], 0
    for k, d, text in zip(keys, ids, texts):
        if len(text) > A.STRETCH:
            for a in range(0, len(text), A.STRETCH):
                low = max(0, a - plan.reach)
                take([text[low : a + A.STRETCH + plan.reach + plan.length]], [k], [d], low, a - low, a - low + A.STRETCH + plan.reach)
            continue
        if size + len(text) > A.STRETCH:
            take(parts, key, doc, 0, 0, None)
            parts, key, doc, size = [], [], [], 0
        parts.append(text)
        key.append(k)
        doc.append(d)
        size += len(text)
    if parts:
        take(parts, key, doc, 0, 0, None)
    kinds = [np.uint64, np.uint64, np.uint16, np.uint16, np.uint64, np.int64, np.int64]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, k) for k in kinds]


def _repeated(gram: np.ndarray) -> np.ndarray:
    """Rows whose gram occurs again."""
    order = np.argsort(gram, kind="stable")
    new = _changes(gram[order])
    single = new & np.append(new[1:], True)
    return np.sort(order[~single])


def _settle(gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by gram, context, document; which rows (in that order) have their context in a smaller document; their gram's number."""
    order = np.lexsort((doc, context, gram))
    g, c, d = gram[order], context[order], doc[order]
    first, number = _bounds(_changes(g, c))
    return order, d > d[first][number], np.cumsum(_changes(g)) - 1


def _anchor_rows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, texts, size = [], [], [], 0
        for batch in batches:
            unzip = zstandard.ZstdDecompressor()
            for number, doc, packed in zip(batch.column("number").to_pylist(), batch.column("doc_id").fill_null(NO_ID).to_pylist(), batch.column("packed").to_pylist()):
                numbers.append(number)
                ids.append(doc)
                texts.append(unzip.decompress(packed))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield _row_batch(_combine(plan, _find_anchors(plan, numbers, ids, texts)))
                    numbers, ids, texts, size = [], [], [], 0
        if texts:
            yield _row_batch(_combine(plan, _find_anchors(plan, numbers, ids, texts)))

    return run


def _combine(plan: Plan, found: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """What a batch sends: marks and crowded grams that it can tell by itself, and the anchors that remain."""
    gram, context, left, right, key, doc, pos = found
    rows: list[tuple[int, int, bytes]] = []
    crowded = np.zeros(len(gram), bool)
    keep = np.ones(len(gram), bool)
    again = _repeated(gram)
    if len(again):
        order, covered, number = _settle(gram[again], context[again], doc[again])
        places = again[order]
        gone = places[covered]
        keep[gone] = False
        rows += plan.marks(key[gone], pos[gone] - plan.reach, pos[gone] + plan.length, lambda b: b % plan.buckets)
        places, number = places[~covered], number[~covered]
        counts = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        for g in np.flatnonzero(counts > CROWD).tolist():
            member = places[number == g]
            low, high = member[doc[member].argmin()], member[doc[member].argmax()]
            if doc[low] != doc[high]:  # two anchors speak for all of them
                keep[member] = False
                keep[[low, high]] = crowded[[low, high]] = True
                member = member[(member != low) & (member != high)]
                for b, part in split_by(plan.doc_bucket(key[member]), key[member], pos[member], np.zeros(len(member), np.int64)):
                    rows.append((b % plan.buckets, CROWDED, pack_arrays(*part)))
    kept = np.flatnonzero(keep)
    kept = kept[np.lexsort((pos[kept], key[kept]))]
    documents, which = np.unique(key[kept], return_inverse=True)
    doc_ids = np.zeros(len(documents), np.int64)
    doc_ids[which] = doc[kept]
    bucket = (gram[kept] % np.uint64(plan.buckets)).astype(np.int64)
    for b, (g, c, x, y, w, p, f) in split_by(bucket, gram[kept], context[kept], left[kept], right[kept], which, pos[kept], crowded[kept]):
        used, w = np.unique(w, return_inverse=True)
        rows.append((b, ANCHOR, pack_arrays(g, c, x, y, np.diff(w, prepend=0).astype(np.uint32), np.diff(p, prepend=0).astype(np.int32) if len(p) and p.max() < 1 << 31 else np.diff(p, prepend=0), f, documents[used], doc_ids[used])))
    return rows


def _shared(gram: np.ndarray, half: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose gram and half occur in two documents or more."""
    order = np.lexsort((doc, half, gram))
    new = _changes(gram[order], half[order])
    first, number = _bounds(new)
    last = np.append(first[1:], len(order)) - 1
    d = doc[order]
    out = np.zeros(len(gram), bool)
    out[order] = (d[last] > d[first])[number]
    return out


def _verdicts(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist(), np.int64)
        payloads = table.column("payload").to_pylist()
        rows: list[tuple[int, int, bytes]] = []
        for k, value in zip(kinds.tolist(), payloads):
            if k in (MARK, CROWDED):
                key = unpack_arrays(value)[0]
                rows.append((int(plan.doc_bucket(key[:1])[0]), k, value))
        parts = []
        for k, value in zip(kinds.tolist(), payloads):
            if k == ANCHOR:
                g, c, x, y, w, p, f, documents, doc_ids = unpack_arrays(value)
                w = np.cumsum(w, dtype=np.int64)
                parts.append((g, c, x, y, documents[w], doc_ids[w], np.cumsum(p, dtype=np.int64), f))
        use = np.zeros(0, np.int64)
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts)]
            del parts
            use = _repeated(columns[0])
        if len(use):
            gram, context, left, right, key, doc, pos, crowded = (x[use] for x in columns)
            del columns
            order, covered, number = _settle(gram, context, doc)
            gone = order[covered]
            rows += plan.marks(key[gone], pos[gone] - plan.reach, pos[gone] + plan.length, lambda b: b)
            first, _ = _bounds(_changes(number))
            d, c = doc[order], context[order]
            several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
            several &= np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first)
            crowd = np.maximum.reduceat(crowded[order].astype(np.int64), first) > 0
            wanted = ~covered & several[number]
            close = (_shared(gram, left, doc) | _shared(gram, right, doc))[order]
            wanted &= close | crowd[number]
            crowd |= np.bincount(number[wanted], minlength=len(first)) > CROWD
            asked, kind = order[wanted], np.where(crowd[number[wanted]], CROWDED, ASK)
            route = ((gram[asked] // np.uint64(plan.buckets)) % np.uint64(plan.index_buckets)).astype(np.int64)
            for k in (ASK, CROWDED):
                s = asked[kind == k]
                for b, part in split_by(plan.doc_bucket(key[s]), key[s], pos[s], route[kind == k]):
                    rows.append((b, k, pack_arrays(*part)))
        return pa.Table.from_batches([_row_batch(rows)])

    return run


def _contexts(plan: Plan):
    """Cut the asked contexts out of a bucket's documents; strings of crowded contexts by their hashes."""

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        asked: dict[int, list] = {}
        docs, verdicts = _documents_apart(table)
        for kind, value in zip(verdicts.column("kind").to_pylist(), verdicts.column("payload").to_pylist()):
            if kind in (ASK, CROWDED):
                for key, (pos, route) in split_by(*unpack_arrays(value)):
                    asked.setdefault(key, []).append((kind, pos, route))
        cut: list[tuple[int, bytes, int, int, int]] = []
        strings: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        unzip = zstandard.ZstdDecompressor()
        for key, doc, packed in zip(docs.column("number").to_pylist(), docs.column("doc_id").fill_null(NO_ID).to_pylist(), docs.column("payload").to_pylist()):
            if key not in asked:
                continue
            text = unzip.decompress(packed)
            for kind, pos, route in asked[key]:
                if kind == ASK:
                    for p, r in zip(pos.tolist(), route.tolist()):
                        a = max(0, p - plan.reach)
                        cut.append((r, text[a : p + plan.length], key, doc, a))
                else:
                    starts = np.unique(np.clip(pos[:, None] - np.arange(plan.reach + 1)[None, :], 0, len(text) - plan.length))
                    digests = b"".join(xxhash.xxh3_128_digest(text[a : a + plan.length]) for a in starts.tolist())
                    strings.append((np.frombuffer(digests, np.uint64).reshape(-1, 2), key, doc, starts))
        if cut:
            route = np.array([c[0] for c in cut], np.int64)
            for b, (w,) in split_by(route, np.arange(len(cut))):
                some = [cut[i] for i in w.tolist()]
                rows.append((b, ASK, pack_arrays(np.frombuffer(b"".join(c[1] for c in some), np.uint8), np.array([len(c[1]) for c in some], np.int64), np.array([c[2] for c in some], np.uint64), np.array([c[3] for c in some], np.int64), np.array([c[4] for c in some], np.int64))))
        if strings:
            hashes, starts = np.concatenate([s[0] for s in strings]), np.concatenate([s[3] for s in strings])
            n = [len(s[3]) for s in strings]
            key, doc = np.repeat(np.array([s[1] for s in strings], np.uint64), n), np.repeat(np.array([s[2] for s in strings], np.int64), n)
            order, later = _later(*hashes.T, doc)
            gone, rest = order[later], order[~later]
            rows += plan.marks(key[gone], starts[gone], starts[gone] + plan.length, lambda b: b % plan.index_buckets)
            for b, part in split_by((hashes[rest, 0] % np.uint64(plan.index_buckets)).astype(np.int64), hashes[rest, 0], hashes[rest, 1], key[rest], doc[rest], starts[rest]):
                rows.append((b, CROWDED, pack_arrays(*part)))
        return pa.Table.from_batches([_row_batch(rows)])

    return run


def _later(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings, and which of them stand in a smaller document; strings are equal if both halves of their 128-bit hashes are."""
    order = np.lexsort((doc, low, high))
    first, number = _bounds(_changes(high[order], low[order]))
    d = doc[order]
    return order, d > d[first][number]


def indexed_marks(body: np.ndarray, lengths: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the runs of bytes covered by strings that also stand in a context of a smaller document."""
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    text = np.zeros(int(ends[-1]), np.uint16)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False  # a separator, symbol 0, behind each context
    text[inside] = body.astype(np.uint16) + 1
    index = RunIndex(text)
    group = index.groups(length, 4 * length)
    first, _ = _bounds(_changes(group))
    smallest = np.minimum.reduceat(doc[owner[index.sa]], first)[group - group[0]]
    marked = np.zeros(len(text), bool)
    marked[index.sa] = doc[owner[index.sa]] > smallest
    place = np.flatnonzero(marked)
    place = place[place + length <= starts[owner[place]] + lengths[owner[place]]]
    if not len(place):
        return place, place, place
    new = (np.diff(place, prepend=-2) != 1) | _changes(owner[place])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    which = owner[place[first]]
    return which, place[first] - starts[which], place[last] - starts[which] + length


def _index_marks(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        asked, crowd = [], []
        for kind, value in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind == MARK:
                rows.append((int(plan.doc_bucket(unpack_arrays(value)[0][:1])[0]), MARK, value))
            else:
                (asked if kind == ASK else crowd).append(value)
        if asked:
            body, lengths, key, doc, start = concat_packed(asked, "u1 i8 u8 i8 i8")
            which, a, b = indexed_marks(body, lengths, doc, plan.length)
            rows += plan.marks(key[which], start[which] + a, start[which] + b, lambda b: b)
        if crowd:
            high, low, key, doc, start = concat_packed(crowd, "u8 u8 u8 i8 i8")
            order, later = _later(high, low, doc)
            gone = order[later]
            rows += plan.marks(key[gone], start[gone], start[gone] + plan.length, lambda b: b)
        return pa.Table.from_batches([_row_batch(rows)])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """text without the given ranges, and how many maximal runs went."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(np.minimum(end[order], len(text)))
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    a, b = start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist()
    return b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])), len(a)


def _results(plan: Plan, with_text: bool):
    def run(table: pa.Table) -> pa.Table:
        docs, marks = _documents_apart(table)
        key, start, end = concat_packed([v for k, v in zip(marks.column("kind").to_pylist(), marks.column("payload").to_pylist()) if k == MARK], MARK_ARRAYS)
        found = {k: (a, b) for k, (a, b) in split_by(key, start, end)}
        unzip, out = zstandard.ZstdDecompressor(), []
        for k, doc, packed in zip(docs.column("number").to_pylist(), docs.column("doc_id").to_pylist(), docs.column("payload").to_pylist()):
            text = unzip.decompress(packed)
            kept, spans = cut_out(text, *found[k]) if k in found else (text, 0)
            out.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    return run


def _packed_documents(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bucket = plan.doc_bucket(batch.column("number").to_numpy().view(np.uint64)).astype(np.int32)
            packed = [zip_.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("number"), batch.column("doc_id"), pa.array(packed, pa.binary())], ["bucket", "number", "doc_id", "packed"])

    return run


def _documents_apart(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows of kind DOCUMENT, and the others."""
    mask = pa.compute.equal(table.column("kind"), DOCUMENT)
    return table.filter(mask), table.filter(pa.compute.invert(mask))


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless with_text)."""
    docs = id_and_text(docs)
    plan = Plan(length, gram, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text")
    corpus = materialize(numbered.mapInArrow(_packed_documents(plan), CORPUS), "numbered-documents", "none")

    def with_documents(rows: DataFrame) -> DataFrame:
        no_row = F.lit(None).cast("long")
        own = corpus.select("bucket", F.lit(DOCUMENT).alias("kind"), "number", "doc_id", F.col("packed").alias("payload"))
        return own.unionByName(rows.select("bucket", "kind", no_row.alias("number"), no_row.alias("doc_id"), "payload"))

    verdicts = materialize(by_bucket(corpus.mapInArrow(_anchor_rows(plan), ROWS), plan.buckets, _verdicts(plan), ROWS), "anchor-verdicts")
    asked = verdicts.where(F.col("kind").isin(ASK, CROWDED))
    contexts = by_bucket(with_documents(asked), plan.doc_buckets, _contexts(plan), ROWS)
    indexed = materialize(by_bucket(contexts, plan.index_buckets, _index_marks(plan), ROWS), "index-marks")
    marks = verdicts.where(F.col("kind") == MARK).unionByName(indexed)
    return by_bucket(with_documents(marks), plan.doc_buckets, _results(plan, with_text), RESULT)
