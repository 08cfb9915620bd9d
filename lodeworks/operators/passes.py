"""Clean-up in passes, with a report: what each pass took in and gave out, counted while the documents flow through it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeworks.operators.documents import clean_documents, text_mode, text_signals
from lodeworks.operators.vision import text_warnings
from lodeworks.sources.shared import materialize

REPORT = "pass string, status string, documents long, input_chars long, output_chars long, documents_with_warnings long, error string"
#: From doc_id, text to doc_id, text, warnings.
Pass = Callable[[DataFrame], DataFrame]


def raw_pass(docs: DataFrame) -> DataFrame:
    return docs.withColumn("warnings", F.array().cast("array<string>"))


def signal_pass(docs: DataFrame) -> DataFrame:
    """doc_id, text, with warnings of the text's layout."""
    signals = text_signals(docs.withColumn("place", F.struct("doc_id", "text")), "place", blank=True)
    return text_warnings(signals).select("place.*", "warnings")


def clean_pass(mode: str | None) -> Pass:
    def run(docs: DataFrame) -> DataFrame:
        return clean_documents(docs, mode).select("doc_id", "text", F.array_compact(F.array("warning")).alias("warnings"))

    return run


def standard_passes(mode: str | None) -> list[tuple[str, Pass]]:
    return [("raw_text_extraction", raw_pass), ("text_signal", signal_pass), ("text_clean", clean_pass(mode))]


def run_passes(docs: DataFrame, mode: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """docs (doc_id, text) -> the cleaned documents (doc_id, text; written), and the report: a row for each pass, in order.

    Counts are observed metrics of the one job that writes the result.  A mode that does not exist fails the first pass, and nothing
    else is done.
    """
    spark = docs.sparkSession
    try:
        text_mode(mode)
    except ValueError as error:
        return None, spark.createDataFrame([("validate_options", "failed", None, None, None, None, str(error))], REPORT)
    chars = F.coalesce(F.sum(F.char_length("text")), F.lit(0))
    rows, seen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), []
    before = Observation("input")
    rows = rows.observe(before, chars.alias("chars"))
    for name, step in standard_passes(mode):
        seen.append((name, watch := Observation(name)))
        rows = step(rows).observe(watch, F.count(F.lit(1)).alias("documents"), chars.alias("chars"), F.count_if(F.size("warnings") > 0).alias("warned")).select("doc_id", "text")
    result = materialize(rows, "cleaned-documents")
    report, taken = [("validate_options", "ok", None, None, None, None, None)], before.get["chars"]
    for name, watch in seen:
        found = watch.get
        report.append((name, "ok", found["documents"], taken, found["chars"], found["warned"], None))
        taken = found["chars"]
    return result, spark.createDataFrame(report, REPORT)
