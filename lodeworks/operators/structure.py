"""Papers' structure and identity: canonical scores, headings, sections, entities, answers' order, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower, squeeze

# Points of identifiers and sources, signs of a known venue, heading words.
KNOWN_VENUES = ["arxiv", "neural information processing", "conference", "journal"]
SOURCE_POINTS = {"semantic": 900, "arxiv": 800, "dblp": 700, "openalex": 250, "crossref": 150}
HEADINGS = ["abstract", "introduction", "related work", "background", "method", "methods", "approach", "experiments", "results", "discussion", "conclusion", "references", "acknowledgments", "acknowledgements", "appendix"]


def suspicious_doi(doi: Column, sources: Column, semantic: Column, arxiv: Column, venue: Column) -> Column:
    weak = (F.size(sources) > 0) & F.forall(sources, lambda s: s.isin("crossref", "openalex", "openalex_reference")) & semantic.isNull() & arxiv.isNull() & venue.isNull()
    return doi.isNotNull() & (F.coalesce(doi.contains("10.65215"), F.lit(False)) | weak)


def canonical_score(exact: Column, doi: Column, arxiv: Column, semantic: Column, openalex: Column, sources: Column, n_authors: Column, venue: Column, year: Column, citations: Column) -> Column:
    """How good a record is as the one that absorbs the others."""
    points = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    identifiers = points(semantic, 2000) + points(arxiv, 1600) + F.when(doi.isNull(), 0).when(suspicious_doi(doi, sources, semantic, arxiv, venue), 100).otherwise(700) + points(openalex, 300)
    of_source = lambda s: reduce(lambda e, kv: e.when(s == kv[0], kv[1]), SOURCE_POINTS.items(), F.when(F.lit(False), 0)).otherwise(0)
    by_source = F.least(F.aggregate(sources, F.lit(0), lambda a, s: a + of_source(s)), F.lit(2400))
    authors = F.least(n_authors, F.lit(8)) * 25
    known = reduce(lambda a, b: a | b, (ascii_lower(venue).contains(v) for v in KNOWN_VENUES))
    venues = F.when(venue.isNull(), 0).when(known, 250).otherwise(120)
    years = F.when(year.isNull(), 50).when(year.between(1900, 2026), 200).otherwise(0)
    c = F.least(F.coalesce(citations, F.lit(0)), F.lit(100_000)).cast("long")
    cited = F.when(c == 0, 0).otherwise((F.char_length(c.cast("string")) - 1) * 120 + F.floor(F.least(c, F.lit(10_000)) / 20))
    return (F.when(exact, 10_000).otherwise(0) + identifiers + by_source + authors + venues + years + cited).cast("long")


def is_heading(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(line), r"^#+\s*", ""))
    low = ascii_lower(bare)
    barred = bare.contains("http://") | bare.contains("@") | low.rlike(r"^(fig\.|figure |table |equation |doi)")
    return (F.char_length(bare).between(1, 120)) & ~barred & (low.isin(*HEADINGS) | bare.rlike("^[0-9]"))


def heading_level(line: Column) -> Column:
    n = F.char_length(F.regexp_extract(line, r"^(#*)", 1))
    return F.when(n == 0, 1).otherwise(F.least(n, F.lit(6)))


def section_id(number: Column, heading: Column) -> Column:
    """Numbers count from 0; other characters than letters and digits become one underscore."""
    slug = F.left(F.regexp_replace(F.regexp_replace(ascii_lower(heading), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(36))
    return F.format_string("sec_%03d_%s", number, slug)


def credible_sections(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """candidates (doc_id, seq, heading, anchor_id, confidence) with a known anchor, confidence 0.5 or more and
    a heading's look; the first of each heading (lower case, squeezed, without hashes), by place; with section ids."""
    known = candidates.join(anchors.select("doc_id", "anchor_id", "byte_start"), ["doc_id", "anchor_id"]).where((F.col("confidence") >= 0.5) & is_heading(F.col("heading")))
    norm = known.withColumn("norm", squeeze(ascii_lower(F.regexp_replace("heading", "^#+", ""))))
    first = norm.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy("seq"))).where("k = 1")
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("byte_start", "seq")) - 1)
    return numbered.select("doc_id", section_id(F.col("number"), F.col("heading")).alias("section_id"), "heading", heading_level(F.col("heading")).alias("level"), "byte_start")


# The kinds of entities, how their ids begin, and what stands for a blank label.
ENTITY_IDS = {"figure": "fig", "table": "tbl", "reference": "ref"}
ENTITY_LABELS = {"figure": "Figure", "table": "Table"}


def number_entities(entities: DataFrame) -> DataFrame:
    """entities (doc_id, seq, kind, label, text) of the known kinds, numbered from 0 by kind: with entity_id, label and caption.

    A blank label of a figure or table gives way to the kind's name; the caption is the text, or the label as it was.
    """
    known = entities.where(F.col("kind").isin(*ENTITY_IDS))
    n = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("seq")) - 1
    start = F.create_map(*(F.lit(x) for pair in ENTITY_IDS.items() for x in pair))[F.col("kind")]
    name = F.create_map(*(F.lit(x) for pair in ENTITY_LABELS.items() for x in pair))[F.col("kind")]
    solid = lambda c: F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", F.col(c))
    rows = known.withColumn("n", n).withColumn("entity_id", F.format_string("%s_%03d", start, F.col("n")))
    return rows.withColumn("caption", F.coalesce(solid("text"), "label")).withColumn("label", F.coalesce(solid("label"), name))


def evidence_index(anchors: DataFrame) -> DataFrame:
    """anchors (doc_id, anchor_id, line, byte_start, byte_end, excerpt) -> doc_id, index: a map of anchor to its last span; a document's anchors are one row."""
    span = F.struct("byte_start", "byte_end", "line", "excerpt")
    last = anchors.groupBy("doc_id", "anchor_id").agg(F.max(span).alias("span"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("anchor_id", "span")))).alias("index"))


def placed_entities(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """Numbered entities with the place of their anchor; null where the anchor is not known."""
    places = anchors.groupBy("doc_id", "anchor_id").agg(F.max("byte_start").alias("byte_start"))
    return number_entities(entities).join(places, ["doc_id", "anchor_id"], "left")


def order_answers(answers: DataFrame, question: str = "question_id") -> DataFrame:
    """Accepted first, then by score, then as they came."""
    return answers.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(F.desc(F.coalesce("accepted", F.lit(False))), F.desc("score"), "pos")))


def first_available(primary: Column, fallback: Column) -> Column:
    """The first content that is not blank."""
    solid = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(solid(primary), solid(fallback))
