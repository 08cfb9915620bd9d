"""Text functions as column expressions: titles, tokens, white space, entities, tails, truncation, budgets' weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that ranking ignores; named entities; the least number of bytes of a token.
STOPWORDS = "a an and are for from how into not of on or the this to with paper".split()
NAMED_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
ENTITY = r"&(lt|gt|amp|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);"
LEAST_TOKEN_BYTES = 3


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_title(c: Column) -> Column:
    """Everything but letters and digits becomes blanks, which are squeezed; A-Z in lower case."""
    return ascii_lower(squeeze(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}\s]", " ")))


def meaningful_tokens(c: Column) -> Column:
    """Tokens of the normalised title with three bytes or more that are no stopwords, repeats included."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(normalize_title(c), " "), lambda t: (F.octet_length(t) >= LEAST_TOKEN_BYTES) & ~F.array_contains(stop, t))


def raw_tokens(c: Column) -> Column:
    """Tokens of the normalised title, short ones and stopwords included, in one pass over the text."""
    return F.split(ascii_lower(c), r"[^\p{IsAlphabetic}\p{N}]+")


def token_hits(query: Column, haystack: Column) -> Column:
    """How many of the query's token occurrences are in the haystack."""
    return F.size(F.filter(query, lambda t: F.array_contains(haystack, t)))


def least_hits(n_tokens: Column) -> Column:
    """Hits that a relevant result needs."""
    return F.when(n_tokens == 0, 0).when(n_tokens <= 2, 1).otherwise(2)


def strong_hits(n_tokens: Column) -> Column:
    """Hits that a strong overlap needs: those of a relevant result for one or two tokens, else three."""
    return F.when(n_tokens <= 2, least_hits(n_tokens)).otherwise(3)


def truncate(c: Column, limit: int) -> Column:
    """content, original_length (characters) and truncated, as a struct."""
    n = F.char_length(c)
    return F.struct(F.left(c, F.lit(limit)).alias("content"), n.cast("long").alias("original_length"), (n > limit).alias("truncated"))


def decode_entities(c: Column) -> Column:
    """Five named entities and decimal and hexadecimal ones, each once, from left to right; all others stay as they are."""

    def decoded(e: Column) -> Column:
        digits = F.when(F.lower(F.substring(e, 2, 1)) == "x", F.conv(F.substring(e, 3, 20), 16, 10)).otherwise(F.substring(e, 2, 20)).try_cast("bigint")
        valid = digits.between(0, 0xD7FF) | digits.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, digits)), 8, "0")), "UTF-32")
        named = reduce(lambda rest, kv: rest.when(e == kv[0], kv[1]), NAMED_ENTITIES.items(), F.when(F.lit(False), ""))
        return F.coalesce(named, F.when(F.startswith(e, F.lit("#")), character), F.concat(F.lit("&"), e, F.lit(";")))

    found = F.regexp_extract_all(c, F.lit(ENTITY), F.lit(1))
    pieces = F.transform(F.split(c, ENTITY, -1), lambda p, i: F.concat(p, F.coalesce(decoded(F.get(found, i)), F.lit(""))))
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


def clean_html_title(c: Column) -> Column:
    """Sub- and superscript tags (small letters, no attributes) go, white space is squeezed."""
    return squeeze(F.regexp_replace(c, "</?su[bp]>", ""))


def source_weight(*parts: Column) -> Column:
    """Characters that a source costs in a response, with a fixed overhead."""
    return reduce(lambda a, p: a + F.coalesce(F.char_length(p), F.lit(0)), parts, F.lit(64))


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def inverted_abstract(index: Column) -> Column:
    """The words of a map word -> positions, by position (ties by word)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda s: s["w"]), " ")
