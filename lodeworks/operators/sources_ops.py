"""Lists of cited sources: union and deduplication, pages, budgets, verifiability."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import source_weight

SOURCE = ("url", "provider", "title", "description", "published_date", "content")


def merge_sources(first: DataFrame, second: DataFrame, session: str = "session_id") -> DataFrame:
    """Ordered union without repeated or blank URLs; the first one stays, first's rows before second's.

    Both have session, pos, url and more.  The result's pos counts from 0.
    """
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True).where(F.trim("url") != "")
    kept = both.withColumn("n", F.row_number().over(Window.partitionBy(session, "url").orderBy("side", "pos"))).where("n = 1")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy("side", "pos")) - 1).drop("n", "side")


def page(rows: DataFrame, session: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of each session, with total and next_offset (null at the end)."""
    w = Window.partitionBy(session)
    numbered = rows.withColumn("n", F.row_number().over(w.orderBy("pos")) - 1).withColumn("total", F.count("*").over(w))
    end = F.least(F.lit(offset + limit), F.col("total"))
    return numbered.where((F.col("n") >= offset) & (F.col("n") < offset + limit)).withColumn("next_offset", F.when(end < F.col("total"), end)).drop("n")


def replace_preferred(candidates: DataFrame, key: str, group: str, preferred: Column) -> DataFrame:
    """One row for each key: at the place of its first row, the first preferred row, else the first."""
    w = Window.partitionBy(group, key)
    ranked = candidates.withColumn("place", F.min("pos").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.when(preferred, 0).otherwise(1), "pos")))
    return ranked.where("n = 1").withColumn("pos", F.col("place")).drop("n", "place")


def unverifiable_reason(answer: Column, n_sources: Column, n_before_filter: Column) -> Column:
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", "content_empty").when(n_sources == 0, F.when(n_before_filter > 0, "sources_empty_filtered").otherwise("sources_empty"))


# The note that stands for content, with the fields that it names, and its two openings.
NOTE = '_[{what}: response budget reached - full text via web_fetch("{url}") or get_sources(session_id="{session}", offset={index}, limit=1)]_'
OMITTED, CUT = "inline content omitted", "truncated"


def _note(template: str, **fields: Column) -> Column:
    """The template with its fields filled in."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def apply_budget(sessions: DataFrame, budget: int, note: str = NOTE, omitted: str = OMITTED, cut_off: str = CUT) -> DataFrame:
    """Trim a session's sources from the last one on until answer and sources fit the budget.

    sessions: session_id, answer, sources (array of structs of SOURCE in order).  Returns session_id,
    sources, total, truncated.  A fold over the array, in the engine; a session is one row.

    From the last source on, while over budget: content that the omission note would not shorten is left;
    content long enough to absorb the excess is cut to the exact budget with a trim note; else the
    omission note takes its place.  Then whole sources go from the end, at least one stays.
    """
    weight = lambda s: source_weight(*(s[c] for c in SOURCE)).cast("long")
    say = lambda what, s, i: _note(note, what=F.lit(what), url=F.coalesce(s["url"], F.lit("")), session=F.col("session_id"), index=i.cast("string"))
    total = F.char_length(F.coalesce(F.col("answer"), F.lit(""))).cast("long") + F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + weight(s))
    start = sessions.withColumn("total", total).withColumn("truncated", F.col("total") > budget)
    indexed = F.reverse(F.transform("sources", lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

    def with_content(s: Column, content: Column) -> Column:
        return F.struct(*((content if c == "content" else s[c]).alias(c) for c in SOURCE))

    def trim(a: Column, x: Column) -> Column:
        s, i = x["s"], x["i"]
        length = F.coalesce(F.char_length(s["content"]), F.lit(0)).cast("long")
        omit, cut = say(omitted, s, i), say(cut_off, s, i)
        over = a["total"] - budget
        fits = length > over + F.char_length(cut) + 2
        shorter = F.concat(F.left(s["content"], (length - over - F.char_length(cut) - 2).cast("int")), F.lit("\n\n"), cut)
        skip = (a["total"] <= budget) | (length == 0) | (length <= F.char_length(omit))
        return F.struct(
            F.when(skip, a["total"]).when(fits, F.lit(budget).cast("long")).otherwise(a["total"] + F.char_length(omit) - length).alias("total"),
            F.concat(F.array(F.when(skip, s).when(fits, with_content(s, shorter)).otherwise(with_content(s, omit))), a["out"]).alias("out"),
        )

    kind = sessions.schema["sources"].dataType
    trimmed = start.withColumn("a", F.aggregate(indexed, F.struct(F.col("total").alias("total"), F.array().cast(kind).alias("out")), trim))
    after = trimmed.select("session_id", "answer", "truncated", F.col("a.out").alias("out"), F.col("a.total").alias("total"))
    dropped = F.aggregate(
        F.reverse("out"),
        F.struct(F.col("total").alias("total"), F.size("out").alias("n")),
        lambda a, s: F.when((a["total"] > budget) & (a["n"] > 1), F.struct((a["total"] - weight(s)).alias("total"), (a["n"] - 1).alias("n"))).otherwise(a),
    )
    final = after.withColumn("d", dropped)
    return final.select("session_id", F.slice("out", F.lit(1), F.col("d.n")).alias("sources"), F.col("d.total").alias("total"), "truncated")
