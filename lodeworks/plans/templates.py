"""SQL of texts with values in their places, read by both engines: payloads that are made from a table's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.tables import table, values


def filled(template: str, **values: str) -> str:
    """SQL of a text with @name@ in the places of values (SQL of texts)."""
    parts = template.split("@")
    return "(" + " || ".join(f"({values[x]})" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x) + ")"


def pick(column: str, *values: str, step: int = 1) -> str:
    """SQL: one of the values, in turn by a column's number."""
    return f"CASE CAST(floor({column} / {step}) AS INT) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def count_rows(rows: str) -> int:
    """The number of tuples in the SQL text of literal rows."""
    depth, quoted, n = 0, False, 0
    for c in rows:
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
            n += depth == 1
        elif not quoted and c in ")]":
            depth -= 1
    return n


def by_page_sql(rows: str, columns: str, texts: str = "", turns: int = 0) -> str:
    """SQL of a row for each page: the literal row in turn by the page's number, which becomes its id (the first column, from 0 on).

    turns: how many rows take turns, where that is not their number (rows of results, several or none to an id).  In the columns `texts`, hosts that end in .example get the page's number, so contents differ from page to page.
    """
    key, *others = (c.strip() for c in columns.split(","))
    named = [t.strip() for t in texts.split(",") if t.strip()]
    values = [f"replace(l.{c}, '.example', concat('-', CAST(page_id AS STRING), '.example')) AS {c}" if c in named else f"l.{c} AS {c}" for c in others]
    return f"(SELECT page_id AS {key}, {', '.join(values)} FROM pages JOIN (SELECT * FROM (VALUES {rows}) AS v({columns})) AS l ON l.{key} = page_id % {turns or count_rows(rows)})"


def by_page(spark: SparkSession, sf_dir: str, rows: str, columns: str, texts: str = "") -> DataFrame:
    """The rows of by_page_sql."""
    key, *others = (c.strip() for c in columns.split(","))
    named = [t.strip() for t in texts.split(",") if t.strip()]
    mark = F.concat(F.lit("-"), F.col("page_id").cast("string"), F.lit(".example"))
    pages = table(spark, sf_dir, "pages").select("page_id")
    met = pages.join(F.broadcast(values(spark, rows, columns)), F.col("page_id") % count_rows(rows) == F.col(key))
    return met.select(F.col("page_id").alias(key), *(F.replace(F.col(c), F.lit(".example"), mark).alias(c) if c in named else F.col(c) for c in others))


def by_group_sql(rows: str, columns: str) -> str:
    """SQL of the literal rows for each page: groups named by the first column (a number below 1000) become groups of the page."""
    key, *others = (c.strip() for c in columns.split(","))
    return f"(SELECT page_id * 1000 + l.{key} AS {key}, {', '.join(f'l.{c}' for c in others)} FROM pages CROSS JOIN (SELECT * FROM (VALUES {rows}) AS v({columns})) AS l)"


def by_group(spark: SparkSession, sf_dir: str, rows: str, columns: str) -> DataFrame:
    """The rows of by_group_sql; the literal side is a few rows."""
    key, *others = (c.strip() for c in columns.split(","))
    met = table(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(values(spark, rows, columns)))
    return met.select((F.col("page_id") * 1000 + F.col(key)).alias(key), *others)


def over(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """SQL over one of the given tables, which both engines read."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))
