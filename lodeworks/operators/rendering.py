"""Markdown of issues, pull requests, repositories, questions, papers and encyclopedia pages; merged comment feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The notes on what is not shown, and headings of answers.
MORE_COMMENTS, MORE_ANSWERS = "_还有 {n} 条评论_\n", "_还有 {n} 条_\n"
ACCEPTED, ANSWER = "## ★ 采纳答案 (↑{score})\n\n", "## 答案 by {author} (↑{score})\n\n"


def _filled(template: str, **fields: Column) -> Column:
    for name in fields:
        template = template.replace("{" + name + "}", f"\0{name}\0")
    return F.concat(*(fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(template.split("\0"))))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"**{label}:** "), value.cast("string"), F.lit("\n"))).otherwise("")


def _rest(n: Column, most: int, template: str) -> Column:
    return F.when(n > most, _filled(template, n=n - most)).otherwise("")


def _first(items: Column, most: int, one) -> Column:
    return F.array_join(F.transform(F.slice(items, F.lit(1), F.lit(most)), one), "")


def merge_comments(talk: DataFrame, inline: DataFrame, reviews: DataFrame) -> DataFrame:
    """Feeds (issue_id, pos, author, body, created_at) of a pull request -> issue_id, comments in order of time, feed by feed on ties; blank review bodies are left out."""
    feeds = [talk, inline, reviews.where(F.trim("body") != "")]
    rows = [f.select("issue_id", F.struct("created_at", F.lit(i).alias("feed"), "pos", "author", "body").alias("c")) for i, f in enumerate(feeds)]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("issue_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return both.select("issue_id", F.transform("c", lambda c: F.struct(c["author"].alias("author"), c["created_at"].alias("created_at"), c["body"].alias("body"))).alias("comments"))


def render_issue(title: Column, state: Column, is_pr: Column, merged: Column, author: Column, labels: Column, body: Column, comments: Column, most: int) -> Column:
    """An issue or pull request and the first comments (array of struct<author, created_at, body>, as they come)."""
    suffix = F.when(is_pr & F.coalesce(merged, F.lit(False)), " (merged)").when(is_pr & (state == "closed"), " (closed, not merged)").otherwise("")
    named = F.when(F.size(labels) > 0, F.array_join(labels, ", "))
    one = lambda c: F.concat(F.lit("### Comment by "), c["author"], F.lit(" ("), c["created_at"], F.lit(")\n\n"), c["body"], F.lit("\n\n"))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), _line("State", F.concat(state, suffix)), _line("Author", author), _line("Labels", named), F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n\n## Comments\n\n"), _first(comments, most, one), _rest(F.size(comments), most, MORE_COMMENTS))


def render_repository(name: Column, description: Column, branch: Column, stars: Column, forks: Column, license: Column, readme: Column) -> Column:
    about = F.when(F.trim(description) != "", F.concat(description, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), name, F.lit("\n\n"), about, _line("Default branch", branch), _line("Stars", stars), _line("Forks", forks), _line("License", license), F.lit("\n## README\n\n"), F.regexp_replace(F.coalesce(readme, F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def render_question(title: Column, body: Column, answers: Column, most: int, most_comments: int) -> Column:
    """A question and its ordered answers (array of struct<accepted, score, author, body, comments: array<struct<author, body>>>); comments of accepted answers only."""
    said = lambda c: F.concat(F.lit("> **"), c["author"], F.lit(":** "), c["body"], F.lit("\n"))

    def one(a: Column) -> Column:
        comments = F.concat(_first(a["comments"], most_comments, said), _rest(F.size(a["comments"]), most_comments, MORE_COMMENTS), F.lit("\n"))
        head = F.when(a["accepted"], _filled(ACCEPTED, score=a["score"])).otherwise(_filled(ANSWER, author=a["author"], score=a["score"]))
        return F.concat(head, a["body"], F.lit("\n\n"), F.when(a["accepted"], comments).otherwise(""))

    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n\n---\n\n"), _first(answers, most, one), _rest(F.size(answers), most, MORE_ANSWERS))


def render_paper(title: Column, authors: Column, categories: Column, abstract_link: Column, pdf_link: Column, summary: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n**Authors:** "), F.array_join(authors, ", "), F.lit("\n\n**Categories:** "), F.array_join(categories, ", "), F.lit("\n\n**Links:** [Abstract]("), abstract_link, F.lit(") | [PDF]("), pdf_link, F.lit(")\n\n## Abstract\n\n"), summary, F.lit("\n"))


def render_article(title: Column, extract: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), extract, F.lit("\n"))
