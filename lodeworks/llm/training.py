"""What the two trained scorers share: folds, bounded samples, logistic regression on soft labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on at most (expected value of a sample), for each kind of row; how far a sample may be above it.
SAMPLE_ROWS, SLACK, SEED = 20_000, 1.2, 42


def fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo parts; a null doc_id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(-1))


def row_sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the rows (all if there are fewer), each drawn by itself, whatever its doc_id."""
    n = rows.count()
    return rows if n <= most else rows.sample(fraction=most / n, seed=SEED)


def bounded(sample: DataFrame, most: int) -> DataFrame:
    """A sample on its way to the driver, in the few columns that are fitted on: never more than SLACK times as many rows as asked for."""
    return sample.limit(int(most * SLACK))


def training_labels(labels: DataFrame, column: str, parts: int, held_out: int, most: int = SAMPLE_ROWS) -> DataFrame:
    """label_doc, label: rows outside the held-out fold, a bounded sample; documents labelled both ways are left out."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id", parts) != held_out)
    known = known.groupBy("doc_id").agg(F.min(column).alias("low"), F.max(column).alias("label")).where("low = label")
    return bounded(row_sample(known, most), most).select(F.col("doc_id").cast("long").alias("label_doc"), F.col("label").cast("int").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(gradient, size: int, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam from zero; gradient(w) gives the gradient of the mean risk."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
