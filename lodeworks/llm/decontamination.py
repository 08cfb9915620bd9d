"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a sequence of tokens (runs of letters and digits, lower case).  Numbers, units behind a
number and names are marked with a type; a template token is the type alone for these and the word itself
otherwise.  A name is a run of capitalised words other than function words, wherever it stands, so it is
a name on both sides alike, and a name of one word may stand for a name of two.  Windows of
``window`` template tokens are hashed on both sides and hash-joined, and their tokens compared; an item shorter than that is
searched with windows of its own length.  Windows of which half or more is placeholders are not searched
as templates.

Verbatim copies are also searched by plain tokens, all windows alike, whatever is a number or a name; so
are found items that are mostly numbers, and copies in other case.  Items of fewer than ``least`` tokens, down to ``shortest``, are
searched as plain text only: as templates they would be found everywhere.  An item of one or two common words is found in every document that
has them; such benchmarks want a larger ``shortest``.

A match lies on a diagonal: the distance of the two positions.  A diagonal that has ``share`` of the
item's searched windows, and half that share of all its windows, is a leak.

Slot consistency.  A re-parameterised question has other values in its slots, but on a diagonal each
value of the item then stands for one value in the document; two of the item's values may become equal.
Diagonals that break this are dropped.  Of an item's diagonals in a document, a whole verbatim copy comes first, then templates that
also hold the other way round, other templates, parts of verbatim copies.  ``same_values`` tells verbatim leaks from re-parameterised ones.

The items' distinct windows are broadcast if their count, which is checked, is at most BROADCAST_WINDOWS; beyond
that both sides are shuffled by hash.  A document's windows are hashed in one generated loop that carries its tokens;
only windows that match leave it.

Defined cases: null and empty texts and items have no tokens and match nothing; items of fewer than
``shortest`` tokens are not looked for; repeated rows of one doc_id or item_id count as one, rows with null ids too; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import materialize, numbered

WINDOW, LEAST, SHORTEST, SHARE = 8, 5, 1, 0.5
BROADCAST_WINDOWS = 200_000
# The marks of a number, a name and a unit, what joins the words of a name; units; capitalised words that are no names.
NUMBER, NAME, UNIT, JOINER = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = "mm|cm|km|m|mg|kg|g|ml|l|ms|min|s|h|seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|meters|meter|metres|metre|kilometers|kilometres|grams|gram|kilograms|liters|liter|litres|litre|miles|mile|feet|foot|inches|inch|pounds|pound|ounces|ounce|dollars|dollar|euros|euro|cents|cent|percent|degrees|hz|khz|mhz"
FUNCTION_WORDS = "I|A|The|If|What|How|When|Where|Who|Which|Why|In|On|At|Of|And|Or|But|Is|Are|Was|Were|It|He|She|They|We|You"
#: (pattern, replacement), one after the other; none looks around, so other SQL engines can run them too.
#: Those for numbers apply to texts that have digits only, those for names to texts that have capitals.
NUMBER_STEPS = [(r"(\p{N})[.,:](\p{N})", "$1$2"), (r"(\p{N})[.,:](\p{N})", "$1$2"), (r"(\p{N}+)", NUMBER + "$1"), (rf"({NUMBER}\p{{N}}+)[ -]?((?i:{UNITS}))([^\p{{L}}\p{{N}}]|$)", f"$1 {UNIT}$2$3")]
JOIN = (rf"({NAME}[\p{{L}}\p{{N}}{JOINER}]+) {NAME}", f"$1{JOINER}")  # each time it runs, names of twice as many words are joined
NAME_STEPS = [(r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll})", f"$1{NAME}$2"), (rf"{NAME}({FUNCTION_WORDS})([^\p{{L}}\p{{N}}]|$)", "$1$2"), JOIN, JOIN]
TOKEN = rf"\p{{L}}\p{{N}}{NUMBER}-{JOINER}"


def marked(rows: DataFrame, key: str) -> DataFrame:
    """key, m: the text in lower case with a mark before each number, name and unit.  In steps, so that each is computed once."""

    def steps(text: Column, replacements: list[tuple[str, str]]) -> Column:
        for pattern, replacement in replacements:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    plain, named = F.col("plain"), F.col("named")
    rows = rows.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("plain"))
    rows = rows.select(key, F.when(plain.rlike(r"\p{Lu}\p{Ll}"), steps(plain, NAME_STEPS)).otherwise(plain).alias("named"))
    return rows.select(key, F.lower(F.when(named.rlike(r"\p{N}"), steps(named, NUMBER_STEPS)).otherwise(named)).alias("m"))


def _typed(word: Column) -> Column:
    return word < F.lit(JOINER)


def windows(rows: DataFrame, key: str, lengths: list[int], plain: bool = False) -> DataFrame:
    """key, length, position, hash of all windows of the given lengths, beside t (all tokens) and words (all marked tokens); plain: of unmarked tokens, without words."""
    if plain:
        tokens = rows.select(F.col(key).cast("long").alias(key), F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias("t"), F.lit(None).cast("array<string>").alias("words"))
    else:
        words = marked(rows, key).select(key, F.array_remove(F.split("m", rf"[^{TOKEN}]+"), "").alias("words"))
        tokens = words.select(key, F.transform("words", lambda w: F.when(_typed(w), F.substring(w, 1, 1)).otherwise(w)).alias("t"), "words")
    # The outer form: the inner one would add filters on the token arrays below itself, which compute them once more each.
    # Each token is hashed once, a window's hash is one of its tokens' hashes.
    hashed = tokens.select(key, "t", "words", F.transform("t", lambda w: F.xxhash64(w)).alias("hashes"))
    starts = F.when(F.size("t") >= min(lengths), F.sequence(F.lit(0), F.size("t") - min(lengths)))
    places = hashed.select(key, "t", "words", "hashes", F.explode_outer(starts).alias("position")).where("position is not null")
    of = lambda n: F.xxhash64(*(F.get(F.col("hashes"), F.col("position") + k) for k in range(n)))
    if len(lengths) == 1:
        return places.select(key, "t", "words", F.lit(lengths[0]).alias("length"), "position", of(lengths[0]).alias("hash"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("length"), of(n).alias("hash")) for n in lengths))).alias("w")
    return places.select(key, "t", "words", "position", each).select(key, "t", "words", "w.length", "position", "w.hash").where(F.size("t") >= F.col("position") + F.col("length"))


def _cut(tokens: str) -> Column:
    """The window's part of an array of all tokens."""
    return F.slice(tokens, F.col("position") + 1, F.col("length"))


def item_windows(items: DataFrame, window: int, least: int, plain: bool = False) -> DataFrame:
    """All that is searched for, one row for each distinct window: l, h, item_t, items (item_id, n_windows, n_all, item_position, item_words)."""
    every = windows(items.select("item_id", "text").distinct(), "item_id", list(range(least, window + 1)), plain)
    every = every.where(F.col("length") == F.least(F.size("t"), F.lit(window))).select("item_id", "length", "position", "hash", _cut("t").alias("t"), _cut("words").alias("words"))
    searched = every.where(F.col("words").isNull() | (F.size(F.filter("words", _typed)) * 2 < F.col("length")))
    n = every.groupBy(F.col("item_id").alias("i")).agg(F.countDistinct("position").alias("n_all"))
    m = searched.groupBy(F.col("item_id").alias("j")).agg(F.countDistinct("position").alias("n_windows"))
    sized = searched.join(n, F.col("item_id").eqNullSafe(F.col("i"))).join(m, F.col("item_id").eqNullSafe(F.col("j")))
    return sized.groupBy(F.col("length").alias("l"), F.col("hash").alias("h"), F.col("t").alias("item_t")).agg(F.collect_list(F.struct("item_id", "n_windows", "n_all", F.col("position").alias("item_position"), F.col("words").alias("item_words"))).alias("items"))


def _diagonals(docs: DataFrame, items: DataFrame, window: int, least: int, share: float, plain: bool) -> DataFrame:
    """doc_id, item_id, diagonal, matched_windows, item_windows, pairs (of values): diagonals with the share of windows."""
    sought = materialize(item_windows(items, window, least, plain), "item-windows")
    lengths = sorted(r["l"] for r in sought.select("l").distinct().collect()) or [window]  # at most `window` values
    small = sought.count() <= BROADCAST_WINDOWS
    met = windows(docs, "doc_id", lengths, plain).join(F.broadcast(sought) if small else sought, (F.col("hash") == F.col("h")) & (F.col("length") == F.col("l")))
    met = met.where(_cut("t") == F.col("item_t")).select("doc_id", "position", _cut("words").alias("words"), F.explode("items").alias("item")).select("doc_id", "position", "words", "item.*")
    met = met.withColumn("diagonal", F.col("position") - F.col("item_position"))
    values = F.when(F.col("words").isNotNull(), F.filter(F.arrays_zip(F.col("item_words").alias("x"), F.col("words").alias("y")), lambda p: _typed(p["x"])))
    found = met.groupBy("doc_id", "item_id", "diagonal").agg(F.countDistinct("item_position").alias("matched_windows"), F.max("n_windows").alias("item_windows"), F.max("n_all").alias("n_all"), F.array_distinct(F.flatten(F.collect_set(values))).alias("pairs"))
    return found.where(F.col("matched_windows") >= F.greatest(F.lit(1), F.ceil(F.col("item_windows") * share), F.ceil(F.col("n_all") * share / 2)))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = LEAST, share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, same_values: the best diagonal of each leaked item in each document."""
    ones = lambda field: F.size(F.array_distinct(F.transform("pairs", lambda p: p[field])))
    same = F.forall("pairs", lambda p: p["x"] == p["y"])
    template = _diagonals(docs, items, window, least, share, False).where(ones("x") == F.size("pairs"))
    template = template.select("doc_id", "item_id", F.when(ones("y") == F.size("pairs"), 2).otherwise(1).alias("kind"), "matched_windows", same.alias("same_values"), "item_windows")
    plain = _diagonals(docs, items, window, min(shortest, least), share, True).select("doc_id", "item_id", F.when(F.col("matched_windows") == F.col("item_windows"), 3).otherwise(0).alias("kind"), "matched_windows", F.lit(True).alias("same_values"), "item_windows")
    best = template.unionByName(plain).groupBy("doc_id", "item_id").agg(F.max(F.struct("kind", "matched_windows", "same_values", "item_windows")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched_windows").cast("long").alias("matched_windows"), F.col("b.item_windows").cast("long").alias("item_windows"), "b.same_values")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold an item; rows are told apart by a number of their own, not by doc_id."""
    rows, row = numbered(docs)
    found = leaks(rows.select(F.col(row).alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias(row)).distinct()
    kept = rows.join(found, row, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
