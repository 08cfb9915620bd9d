"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its non-blank lines (split at \\n, trailing blanks ignored for
comparison).  A window is ``window`` consecutive lines.  Of each window the line with the smallest
hash is selected (the leftmost on ties): equal windows select the same line at the same place, so
every repeated run of at least ``window`` lines shares a selected line.  A document gives one row for each selected
position, however many windows selected it; positions whose line is selected at one place only
are discarded by a count that is combined before the shuffle.

The others are joined by what surrounds them.  A position is extended to both sides, to each window that selected it;
positions with equal lines on both sides (a 128-bit hash) meet at the first of them in (doc_id, line) order, and all
later ones are repetitions.  What they cover goes: the windows of neighbouring positions overlap, so later
runs go whole, however long; the first copy stays.  A line of ``long_line`` characters or more is a passage by itself: it
is a position extended by nothing.

Defined cases: null text is an empty document; blank lines are neither counted nor deleted; in a
document of fewer lines than ``window`` only long lines can go; repetitions inside a document go too; rows
with one doc_id and one text are the same document and do not delete each other, with different
texts they are documents in the order of a hash of the text; a null doc_id sorts first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import id_and_text, materialize

WINDOW = 3
LONG_LINE = 240  # characters, some 40 to 50 words
DOCUMENT = ("doc_id", "text_hash")
WAYS = "array<struct<k1:bigint,k2:bigint,start:int,covers:array<int>>>"


def _positions(docs: DataFrame, window: int, long_line: int) -> DataFrame:
    """doc_id, text_hash, position, fingerprint, ways (k1, k2, start, lines covered): one row for each selected position or long line."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.rtrim(x).alias("x")))
    solid = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(numbered, lambda s: s["x"] != "").alias("solid")).where(F.size("solid") > 0)
    field = lambda f: F.transform("solid", f)
    hashed = solid.select(*DOCUMENT, field(lambda s: s["i"]).alias("at"), field(lambda s: F.xxhash64(s["x"])).alias("h"), field(lambda s: F.xxhash64(s["x"], F.lit(1))).alias("g"), field(lambda s: F.length(s["x"]) >= long_line).alias("long"))
    lines = lambda column, i: [F.get(F.col(column), i + k) for k in range(window)]

    def selected(i: Column) -> Column:
        h = lines("h", i)
        smallest = F.least(*h) if window > 1 else h[0]
        return i + reduce(lambda rest, k: F.when(h[k] == smallest, k).otherwise(rest), reversed(range(window)), F.lit(0))

    last = F.size("h") - window  # start of the last window
    chosen = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), selected)).otherwise(F.array().cast("array<int>"))
    alone = F.filter(F.transform("long", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    spots = hashed.withColumn("chosen", chosen).withColumn("position", F.explode(F.array_distinct(F.concat("chosen", alone))))
    p = F.col("position")
    around = F.filter(F.sequence(F.greatest(p - window + 1, F.lit(0)), F.least(p, last)), lambda i: F.get(F.col("chosen"), i) == p)
    extended = F.transform(around, lambda i: F.struct(F.xxhash64(*lines("h", i)).alias("k1"), F.xxhash64(*lines("g", i)).alias("k2"), i.alias("start"), F.array(*lines("at", i)).alias("covers")))
    single = F.array(F.struct(F.get("h", p).alias("k1"), F.get("g", p).alias("k2"), p.alias("start"), F.array(F.get("at", p)).alias("covers")))
    none = F.array().cast(WAYS)
    ways = F.concat(F.when(last >= 0, extended.cast(WAYS)).otherwise(none), F.when(F.get("long", p), single.cast(WAYS)).otherwise(none))
    return spots.select(*DOCUMENT, "position", F.get("h", p).alias("fingerprint"), ways.alias("ways"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, text_hash, covers (line numbers) of each window or long line that also starts earlier."""
    positions = _positions(docs, window, long_line)
    where = F.struct(*DOCUMENT, "position")
    again = positions.groupBy("fingerprint").agg(F.min(where).alias("a"), F.max(where).alias("z")).where("a <> z").select(F.col("fingerprint").alias("f"))
    again = materialize(again, "line-fingerprints")  # written: the join below gets an exchange of its own, which AQE can split where a line is hot
    joined = positions.join(again, F.col("fingerprint") == F.col("f"), "left_semi")
    extended = materialize(joined.select(*DOCUMENT, F.explode("ways").alias("way")).select(*DOCUMENT, "way.*"), "line-extensions")
    place = F.struct(*DOCUMENT, "start")
    first = extended.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "first")
    first = materialize(first, "line-firsts")
    hit = extended.join(first, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")))
    return hit.where(place > F.col("first")).select(*DOCUMENT, "covers")


def line_dedup(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, text without the later repeated runs, n_lines (non-blank ones), n_removed."""
    docs = id_and_text(docs)
    gone = repeated_runs(docs, window, long_line).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("gone"))
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    lines = joined.select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    return lines.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"),
        F.size(F.filter("lines", lambda x: F.rtrim(x) != "")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
