"""Requests to providers as column expressions: prompts, bodies as JSON, filters, orders, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import ascii_lower

#: The system prompt of a search, if none is given.
SYSTEM = "Search the web, answer briefly, and name the pages that each statement rests on; say it where they are few or doubtful."
# Fixed value: where questions are asked.
QUESTIONS = "https://api.stackexchange.com/2.3/questions/"


def _if(condition: Column, text: Column) -> Column:
    return F.when(condition, text).otherwise("")


def search_prompt(query: Column, platform: Column, days: Column, include: Column, exclude: Column, extra: Column) -> Column:
    """The query with what it is restricted to; extra: array of struct<url, title> that are listed."""
    listed = F.array_join(F.transform(extra, lambda s: F.concat(F.lit("- "), s["url"], F.coalesce(F.concat(F.lit(" | "), s["title"]), F.lit("")), F.lit("\n"))), "")
    return F.concat(
        query,
        _if(F.coalesce(platform, F.lit("")) != "", F.concat(F.lit("\n\nFocus platform: "), platform)),
        _if(days.isNotNull(), F.concat(F.lit("\n\nRestrict evidence to sources published within the last "), days.cast("string"), F.lit(" day(s)."))),
        _if(F.size(include) > 0, F.concat(F.lit("\n\nPrefer sources from: "), F.array_join(include, ", "))),
        _if(F.size(exclude) > 0, F.concat(F.lit("\n\nDo not cite sources from: "), F.array_join(exclude, ", "))),
        _if(F.size(extra) > 0, F.concat(F.lit("\n\nAdditional sources:\n"), listed)),
    )


def source_search_body(query: Column, most: Column, days: Column, include: Column, exclude: Column) -> Column:
    """A source search's body; empty filters are left out."""
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.to_json(F.struct(query.alias("query"), most.alias("max_results"), F.lit(False).alias("include_answer"), days.alias("days"), F.when(days.isNotNull(), "news").alias("topic"), some(include).alias("include_domains"), some(exclude).alias("exclude_domains")))


def map_body(url: Column, most: Column) -> Column:
    return F.to_json(F.struct(url.alias("url"), F.lit(1).alias("max_depth"), most.alias("limit")))


def chat_payload(model: Column, system: Column, prompt: Column, search: Column) -> Column:
    """A chat-completion request; a blank system prompt becomes the fixed one."""
    system = F.when(F.trim(F.coalesce(system, F.lit(""))) != "", system).otherwise(SYSTEM)
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    tools = F.when(search, F.array(F.struct(F.lit("web_search").alias("type"))))
    return F.to_json(F.struct(model.alias("model"), F.array(say("system", system), say("user", prompt)).alias("messages"), F.lit(False).alias("stream"), tools.alias("tools")))


def answer_payload(model: Column, system: Column, prompt: Column, search: Column, social: Column) -> Column:
    """A request for an answer; a blank system prompt is left out, tools are listed as asked for."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    given = F.array_compact(F.array(F.when(F.trim(F.coalesce(system, F.lit(""))) != "", say("system", system)), say("user", prompt)))
    tools = F.transform(F.array_compact(F.array(F.when(search, F.lit("web_search")), F.when(social, F.lit("x_search")))), lambda t: F.struct(t.alias("type")))
    return F.to_json(F.struct(model.alias("model"), given.alias("input"), tools.alias("tools"), F.lit(False).alias("stream")))


def works_filter(first: Column, last: Column, open_only: Column) -> Column:
    parts = F.concat_ws(",", F.concat(F.lit("from_publication_date:"), first.cast("string"), F.lit("-01-01")), F.concat(F.lit("to_publication_date:"), last.cast("string"), F.lit("-12-31")), F.when(F.coalesce(open_only, F.lit(False)), "is_oa:true"))
    return F.nullif(parts, F.lit(""))


def works_order(sort: Column, first: Column, last: Column) -> Column:
    name = ascii_lower(F.trim(sort))
    return F.when(name == "citations", "cited_by_count:desc").when((name == "date") & (first.isNotNull() | last.isNotNull()), "publication_date:desc")


def year_filter(first: Column, last: Column) -> Column:
    """One year, a range, or a range that is open on one side."""
    span = F.concat(F.coalesce(first.cast("string"), F.lit("")), F.lit("-"), F.coalesce(last.cast("string"), F.lit("")))
    return F.when(first == last, first.cast("string")).when(first.isNotNull() | last.isNotNull(), span)


def papers_order(sort: Column) -> Column:
    name = ascii_lower(F.trim(sort))
    return F.when(name == "citations", "citationCount:desc").when(name == "date", "publicationDate:desc")


def page_size(most: Column) -> Column:
    """One more than is shown, so that it is known whether there is more; between 1 and 100."""
    return F.least(F.greatest(most + 1, F.lit(1)), F.lit(100)).cast("string")


def comment_addresses(owner: Column, repo: Column, number: Column, most: Column) -> Column:
    """The three feeds of a pull request: talk, comments on lines, reviews."""
    of = lambda kind, feed: F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/"), repo, F.lit(f"/{kind}/"), number, F.lit(f"/{feed}?per_page="), page_size(most))
    return F.array(of("issues", "comments"), of("pulls", "comments"), of("pulls", "reviews"))


def question_address(id: Column, site: Column, marker: str) -> Column:
    return F.concat(F.lit(QUESTIONS), id, F.lit("?site="), site, F.lit(f"&filter={marker}"))


def answers_address(id: Column, site: Column, marker: str, most: Column) -> Column:
    return F.concat(F.lit(QUESTIONS), id, F.lit("/answers?site="), site, F.lit(f"&filter={marker}&order=desc&sort=votes&pagesize="), page_size(most))
