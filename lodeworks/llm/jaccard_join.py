"""N-gram Jaccard join: documents whose sets of word shingles are similar enough, by signature trees.

Sets.  Rows with equal sets are one class; its first row stands for it, so copies cost one row of a few numbers each.

Which sets share a tree.  In any order of the shingles that is the same for all documents, two similar sets share one of the first
shingles of each (the prefix filter).  Rare shingles come first, by counters of fixed number.  The sets that
have a shingle in their prefix are joined by a tree; a shingle of one set needs none.

Seeds.  First each tree's sets are linked along its order (by size) and with the one that has the fewest rarer shingles, which is what
the others are copies of, if it is there.  Pairs that their signatures allow are verified on whole sets; what is similar is a group.

Traversal.  Trees whose sets are all of one group are done.  The others are traversed against themselves (signature_tree): subtrees
of one group or with too few common bits are left out, the pairs of different groups that remain are verified too.  So a large group of near copies costs links
in proportion to its size, and no link between different groups is missed.  A tree of more than TREE_ROWS sets is cut: its largest group and the rest are
dealt to parts, and each two parts, but for two of the largest group, are a task's trees that are traversed against each other.

Defined cases: null text is empty; texts without words have no shingles, link with nothing and are their own component; texts of
fewer words than a shingle have one shingle of all of them; equal sets link; every row is a document of its own, also where ids repeat or
are null, and a component's id is its smallest doc_id that is not null (null if there is none); an empty table gives an empty
result; other columns are ignored.  Shingles are compared by 64-bit hashes, equal sets found by 128 bits and the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import by_bucket, concat_packed, id_and_text, materialize, mix64, pack_arrays, parallelism, release, split_by
from lodeworks.llm.components import connected_components
from lodeworks.llm.prefix_filter import SLOTS, shingle_ranks
from lodeworks.llm.shingles import shingle_sets
from lodeworks.llm.signature_tree import enough, may_link, signature, tree_join

WORDS, NUM, DEN = 4, 85, 100
BATCH_ROWS = 500_000
#: Prefix entries and rows of trees for each bucket.
BUCKET_ENTRIES, BUCKET_ROWS = 500_000, 100_000
#: Sets of a tree beyond which it is cut into parts; parts are of TREE_ROWS up to FEW_PARTS, then larger, of PART_ROWS at most.
TREE_ROWS, FEW_PARTS, PART_ROWS = 256, 16, 4096
PAIRS = 1 << 20
ENTRY = "<u8 <i8 <i8 <i8"  # shingle, set, size, place in the set's order
MET = "u long, v long, shingle long, size long, overlap long"  # a pair u, v; or a member u of the shingle's tree


def prefix(shingles: np.ndarray, ranks: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of a sorted set, rarest first; empty where no other set can be similar."""
    n = len(shingles)
    if den * n < num * (n + 1):
        return shingles[:0]
    return shingles[np.argsort(ranks[(shingles % np.uint64(SLOTS)).astype(np.int64)], kind="stable")[: n + num * n // -den + 1]]


def shingled(docs: DataFrame, ranks: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """row, doc_id, text, size, h1, h2 (of the whole set), prefix, signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out = []
                for s in shingle_sets(piece.column("text"), words):
                    mixed = mix64(s)
                    both = (np.bitwise_xor.reduce(mixed), mix64(s ^ np.uint64(len(s))).sum(dtype=np.uint64)) if len(s) else (np.uint64(0), np.uint64(0))
                    out.append((len(s), *(int(x.view(np.int64)) for x in both), prefix(s, ranks, num, den).tobytes(), signature(s).tobytes()))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), piece.column("text"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["row", "doc_id", "text", "size", "h1", "h2", "prefix", "signature"])

    rows = id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, text string, size long, h1 long, h2 long, prefix binary, signature binary")


def _runs(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs of a sorted column."""
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(shingle))


def _with_partner(shingle: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the smallest other set of a row's shingle is small enough for it; rows are sorted by shingle and size.

    A set that has the shingle late in its order can be similar to smaller ones only, if this is the first shingle that they share.
    """
    first, count = _runs(shingle)
    least = np.repeat(size[first], count) if len(first) else size
    more = first[count > 1]
    least[first] = np.iinfo(np.int64).max // (4 * den)  # no other set
    least[more] = size[more + 1]
    return enough(size - place, size, least, num, den)


def seeds(shingle: np.ndarray, doc: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs along each shingle's order by size, and with its centre; and the rows of shingles of three sets or more."""
    order = np.lexsort((doc, size, shingle))
    order = order[_with_partner(shingle[order], size[order], place[order], num, den)]
    shingle, doc, size, place = shingle[order], doc[order], size[order], place[order]
    first, count = _runs(shingle)
    run = np.repeat(np.arange(len(first)), count)
    ahead = np.flatnonzero(run[1:] == run[:-1])
    by_place = np.lexsort((doc, place, run))
    centre = by_place[first][run] if len(first) else run
    out = []
    for a, b in ((ahead, ahead + 1), (np.arange(len(run)), centre)):
        near = (doc[a] != doc[b]) & enough(np.minimum(size[a] - place[a], size[b] - place[b]), size[a], size[b], num, den)
        out.append((doc[a[near]], doc[b[near]]))
    return out, order[count[run] > 2]


def _pair_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(c) for c in zip(*held))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(pairs.shape[1], pa.int64()) for _ in range(3))], ["u", "v", "shingle", "size", "overlap"])


def meetings(sets: DataFrame, entries: int, num: int, den: int) -> DataFrame:
    """Rows of MET from the sets' prefixes (row, size, prefix)."""
    buckets = max(parallelism(sets.sparkSession), entries // BUCKET_ENTRIES)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        parts = [(b, pack_arrays(*part)) for b, part in split_by((mix64(columns[0]) % np.uint64(buckets)).astype(np.int64), *columns)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["bucket", "payload"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for row, size, value in zip(*(batch.column(c).to_pylist() for c in ("row", "size", "prefix"))):
                found = np.frombuffer(value, np.uint64)
                n = len(found)
                held.append((found, np.full(n, row, np.int64), np.full(n, size, np.int64), np.arange(n, dtype=np.int64)))
                rows += n
                if rows >= BATCH_ROWS:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    def meet(table: pa.Table) -> pa.Table:
        shingle, doc, size, place = concat_packed(table.column("payload").to_pylist(), ENTRY)
        pairs, members = seeds(shingle, doc, size, place, num, den)
        rows = pa.RecordBatch.from_arrays([pa.array(doc[members]), pa.nulls(len(members), pa.int64()), pa.array(shingle[members].view(np.int64)), pa.array(size[members]), pa.array((size - place)[members])], ["u", "v", "shingle", "size", "overlap"])
        return pa.Table.from_batches([rows, _pair_batch(pairs)])

    return by_bucket(sets.select("row", "size", "prefix").mapInArrow(spread, "bucket int, payload binary"), buckets, meet, MET)


def allowed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) whose signatures allow the similarity."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("signature_u", "signature_v", "size_u", "size_v"))
            keep = [may_link(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), m, n, num, den) for a, b, m, n in zip(*columns)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("row").alias(x), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"signature_{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "signature_u", "signature_v", "size_u", "size_v").mapInArrow(test, "u long, v long")


def verified(rows: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v; materialised) whose whole sets are similar."""
    asked = materialize(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct(), "asked-rows")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array([s.tobytes() for s in shingle_sets(piece.column("text"), words)], pa.binary())], ["id", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sets = materialize(rows.select("row", "text").join(asked, "row", "left_semi").mapInArrow(shingle, "id long, shingles binary"), "asked-shingles", "lz4")
    side = lambda x, name: sets.select(F.col("id").alias(x), F.col("shingles").alias(name))
    links = materialize(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "links")
    release(asked, sets)
    return links


def tree_cells(members: DataFrame, tree_rows: int) -> DataFrame:
    """Members (u, shingle, known, size, overlap) of the trees of several groups, with x, y, part: the trees, or parts of them, that meet in a task.

    Parts of a tree's largest group come last and do not meet each other.
    """
    sizes = members.groupBy("shingle", "known").agg(F.count("*").alias("n"))
    trees = sizes.groupBy("shingle").agg(F.sum("n").alias("n"), F.max(F.struct("n", "known")).alias("top")).where("n > top.n")
    each = F.greatest(F.lit(tree_rows), F.least(F.ceil(F.col("n") / FEW_PARTS), F.lit(max(tree_rows, PART_ROWS))))
    whole, parts = F.col("n") <= tree_rows, lambda n: F.ceil(n / each).cast("int")
    trees = trees.select("shingle", F.col("top.known").alias("largest"), F.when(whole, 1).otherwise(parts(F.col("n") - F.col("top.n"))).alias("others"), F.when(whole, 0).otherwise(parts(F.col("top.n"))).alias("parts"))
    rows = members.join(materialize(trees, "mixed-trees"), "shingle")
    of = lambda n: F.pmod(F.xxhash64("u"), n).cast("int")
    rows = rows.withColumn("part", F.when((F.col("parts") > 0) & (F.col("known") == F.col("largest")), F.col("others") + of(F.greatest("parts", F.lit(1)))).otherwise(of("others")))
    meets = F.when(F.col("part") < F.col("others"), F.sequence(F.lit(0), F.col("others") + F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.select("u", "shingle", "known", "size", "overlap", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))


def traversed(members: DataFrame, sets: DataFrame, num: int, den: int, tree_rows: int) -> DataFrame:
    """Pairs (u, v) of different groups that the trees' dual traversals find."""
    cells = materialize(tree_cells(members, tree_rows), "tree-cells")
    buckets = max(parallelism(members.sparkSession), cells.count() // BUCKET_ROWS)

    def join(table: pa.Table) -> pa.Table:
        u, shingle, known, size, overlap, part, x, y = (table.column(c).to_numpy() for c in ("u", "shingle", "known", "size", "overlap", "part", "x", "y"))
        signatures = table.column("signature").to_pylist()
        order = np.lexsort((y, x, shingle))
        changed = (np.diff(shingle[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(order)]
        held, rows, found = [], 0, []
        for a, b in zip(cuts, cuts[1:]):
            k = order[a:b]
            if x[k[0]] != y[k[0]] and len(np.unique(part[k])) < 2:
                continue
            for i, j in tree_join([signatures[i] for i in k.tolist()], size[k], overlap[k], known[k], part[k], num, den):
                held.append((u[k[i]], u[k[j]]))
                rows += len(i)
                if rows >= PAIRS:
                    found.append(_pair_batch(held))
                    held, rows = [], 0
        if held:
            found.append(_pair_batch(held))
        return pa.Table.from_batches(found).select(["u", "v"]) if found else pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    dealt = cells.join(sets.select(F.col("row").alias("u"), "signature"), "u").withColumn("bucket", F.pmod(F.xxhash64("shingle", "x", "y"), F.lit(buckets)).cast("int"))
    pairs = materialize(by_bucket(dealt, buckets, join, "u long, v long").distinct(), "tree-pairs")
    release(cells)
    return pairs


def set_components(rows: DataFrame, classes: DataFrame, words: int, num: int, den: int, tree_rows: int) -> DataFrame:
    """node, root of the sets that are linked with others; sets are named by their class's first row."""
    first = classes.select(F.col("node").alias("row"))
    prefixed = rows.where(F.length("prefix") > 0)
    entries = prefixed.agg(F.sum(F.length("prefix"))).first()[0] or 0
    met = materialize(meetings(prefixed.select("row", "size", "prefix").join(first, "row", "left_semi"), entries // 8, num, den), "tree-members")
    sets = prefixed.select("row", "size", "signature")
    pairs = materialize(met.where("v is not null").select("u", "v").distinct(), "seed-pairs")
    possible = materialize(allowed(pairs, sets, num, den), "possible-pairs")
    groups = materialize(connected_components(verified(rows, possible, words, num, den), "seed-components"), "seed-groups")
    release(possible)

    members = met.where("v is null").join(groups.select(F.col("node").alias("u"), "root"), "u", "left").select("u", "shingle", F.coalesce("root", "u").alias("known"), "size", "overlap")
    members = materialize(members, "grouped-members")
    more = traversed(members, sets, num, den, tree_rows)
    fresh = materialize(more.join(pairs, ["u", "v"], "left_anti"), "fresh-pairs")
    release(met, pairs, members, more)
    if fresh.isEmpty():
        return groups
    found = verified(rows, fresh, words, num, den)
    return connected_components(groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found), "all-components")


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links between documents of a similarity of num / den or more."""
    rows = materialize(shingled(docs, shingle_ranks(id_and_text(docs), words), words, num, den), "shingled-rows")
    classes = materialize(rows.where("size > 0").groupBy("h1", "h2", "size").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "set-classes")
    roots = set_components(rows, classes, words, num, den, tree_rows)
    named = materialize(classes.join(roots, "node", "left").select("h1", "h2", "size", "least", F.coalesce("root", "node").alias("root")), "named-classes")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    named = materialize(named.join(smallest, "root").select("h1", "h2", "size", "component_id"), "named-sets")
    found = rows.select("doc_id", "size", "h1", "h2").join(named, ["h1", "h2", "size"], "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
