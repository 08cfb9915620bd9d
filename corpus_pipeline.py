"""From raw documents to packed training sequences: quality, exact and near copies, benchmark leaks, packing.

Every stage decides row by row: where an operator names rows by doc_id, the stage gives each row a number of its own and
the operator works on that, so repeated and null doc_ids neither take other rows with them nor save copies.

In all stages: null text counts as empty; repeated rows are rows of their own; an empty table gives an empty one; extra
columns pass through the filtering stages untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import materialize, numbered, read
from lodeworks.llm.decontamination import leaks
from lodeworks.llm.exact_dedup import exact_dedup
from lodeworks.llm.packing import pack_documents
from lodeworks.llm.quality import good_documents
from lodeworks.llm.simhash import near_duplicates

TOKENIZER = "byte_bpe_50k.json"


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose number (column row) is in gone (one column), and without the numbers."""
    kept = docs.join(gone.toDF(row), row, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns if c != row))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects (score below 0.7) go.

    Equal texts share one fate; without any positive label all scores are 0.5 and all rows go.
    """
    return good_documents(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks one row stays: the longest, then the smallest doc_id (null last), then any one."""
    rows, row = numbered(docs)
    return _without(rows, row, exact_dedup(rows, row=row).where("not kept").select("row"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays (null last; of rows with that doc_id any one).

    Rows with equal shingle sets are near copies, texts without words too.
    """
    rows, row = numbered(docs)
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    members = groups.select(F.col("doc_id").alias("member"), "keep_id").union(groups.select("keep_id", "keep_id").distinct())
    members = materialize(rows.select(row, "doc_id").join(members, F.col(row) == F.col("member")).select("member", "keep_id", F.struct(F.col("doc_id").isNull(), "doc_id", "member").alias("place")), "near-members")
    best = materialize(members.groupBy(F.col("keep_id").alias("group")).agg(F.min("place").alias("best")), "near-best")
    return _without(rows, row, members.join(best, F.col("keep_id") == F.col("group")).where(F.col("member") != F.col("best.member")).select("member"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, as it is or re-parameterised, go, whatever their doc_id."""
    rows, row = numbered(docs)
    found = leaks(rows.select(F.col(row).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(rows, row, found.select("doc_id").distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed; an empty text is its end token alone, a null doc_id stays null."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier, SimHash components and a tokenizer: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
