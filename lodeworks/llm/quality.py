"""Quality by positive-unlabelled learning.

Trusted positives are training rows labelled good; all other web text is unlabelled.  Documents are
described by their form: kinds of characters, length and case of words, repetition of words and
lines, punctuation.  Each feature is cut into bins at quantiles of the samples; the model is
linear in the bins.

The share of good text, the class prior, is estimated from scores of a first classifier of positives against
unlabelled text: for every threshold the share of unlabelled text above it is at least the
prior times that of positives, so the smallest ratio, taken with a margin for its sampling error, bounds the prior
(best-bin estimation).  The classifier then minimises the non-negative unbiased risk: prior times the risk of
positives, plus the risk of unlabelled text as negative less prior times that of positives as negative,
where that difference may not go below zero; a step that finds it there turns it back.

Samples are bounded (SAMPLE_ROWS positives, as many unlabelled rows) and drawn before any text is described; every
document is then scored over its whole text in one pass.  Labels, lang, source and doc_id are never features.

Defined cases: null and empty texts have all features zero and are scored by them; repeated rows are
scored alike; without positives every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import id_and_text
from lodeworks.llm.training import SAMPLE_ROWS, bounded, descend, fold, row_sample, sigmoid, training_labels

HELD_OUT = (4, 2)
THRESHOLD = 0.7
BINS = 12
FEATURES = ["upper", "lower", "digits", "blanks", "pipes", "exclamations", "full stops", "commas", "other symbols", "high bytes", "log words", "mean word", "long words", "short words", "capitalised", "distinct words", "repeated neighbours", "log words a line", "distinct lines", "ended by symbols"]


def _character_classes() -> np.ndarray:
    table = np.zeros((256, 10))
    for b in range(256):
        c = chr(b)
        kind = 9 if b >= 128 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c.isspace() else {"|": 4, "!": 5, ".": 6, ",": 7}.get(c, 8)
        table[b, kind] = 1
    return table


CLASSES = _character_classes()


def features(text: str) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    out[:10] = np.bincount(raw, minlength=256) @ CLASSES / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    out[10:] = (
        np.log(n),
        sizes.mean(),
        (sizes > 12).mean(),
        (sizes <= 3).mean(),
        sum(map(str.istitle, words)) / n,
        len(set(words)) / n ** 0.9,
        sum(map(str.__eq__, words, words[1:])) / n,
        np.log(n / len(lines)),
        len(set(lines)) / len(lines),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\"" for w in words) / n,
    )
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, x (array<double>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, x array<double>")


class Binned:
    """Each feature's bin number as one of BINS indicators."""

    def __init__(self, x: np.ndarray) -> None:
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], [0.01, *quantiles, 0.99])) for j in range(x.shape[1])]
        self.sizes = [len(e) + 1 for e in self.edges]
        self.starts = np.cumsum([0, *self.sizes])

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) numbers of the indicators that are on."""
        return np.stack([np.searchsorted(e, x[:, j], "right") + s for j, (e, s) in enumerate(zip(self.edges, self.starts))], axis=1)

    @property
    def total(self) -> int:
        return int(self.starts[-1])


def _scores(w: np.ndarray, on: np.ndarray) -> np.ndarray:
    return w[on].sum(axis=1) + w[-1]


def _spread(error: np.ndarray, on: np.ndarray, total: int) -> np.ndarray:
    """Gradient of the sum of error * score."""
    return np.append(np.bincount(on.ravel(), np.repeat(error, on.shape[1]), total), error.sum())


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate from scores of rows that the classifier was not fitted on."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    use = p > 0.05
    best = np.argmin((u[use] + margin) / p[use])
    return float(np.clip(u[use][best] / p[use][best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-3) -> tuple[Binned, np.ndarray, float]:
    """The bins, the weights and the estimated prior."""
    bins = Binned(np.concatenate([positive, unlabelled]))
    p, u, total = bins.columns(positive), bins.columns(unlabelled), bins.total

    def naive(part_p: np.ndarray, part_u: np.ndarray):
        def gradient(w: np.ndarray) -> np.ndarray:
            g = _spread(sigmoid(_scores(w, part_p)) - 1, part_p, total) / len(part_p) + _spread(sigmoid(_scores(w, part_u)), part_u, total) / len(part_u)
            return g / 2 + l2 * np.append(w[:-1], 0)

        return gradient

    w = descend(naive(p[::2], u[::2]), total + 1, 200)
    prior = estimate_prior(_scores(w, p[1::2] if len(p) > 1 else p), _scores(w, u[1::2] if len(u) > 1 else u))

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _scores(w, p), _scores(w, u)
        as_positive = _spread(sigmoid(sp) - 1, p, total) / len(p) * prior
        as_negative = _spread(sigmoid(su), u, total) / len(u) - prior * _spread(sigmoid(sp), p, total) / len(p)
        risk = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        return (-as_negative if risk < 0 else as_positive + as_negative) + l2 * np.append(w[:-1], 0)

    return bins, descend(gradient, total + 1, 500, 0.05), prior


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Binned, np.ndarray, float] | None:
    """The model; None without positives or without documents."""
    parts, part = HELD_OUT
    docs = id_and_text(docs)
    trusted = training_labels(labels, "quality", parts, part, 2 * sample_rows).where("label = 1")
    # At most 2 * sample_rows labels: a bounded side.
    positive = docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("label_doc"), "left_semi")
    matrix = lambda df: np.array([list(x) for x in bounded(feature_rows(row_sample(df, sample_rows)).select("x"), sample_rows).toPandas()["x"]], float).reshape(-1, len(FEATURES))
    p, u = matrix(positive), matrix(docs)
    return fit(p, u) if len(p) and len(u) else None


def score_column(model: tuple[Binned, np.ndarray, float] | None, text: Column) -> Column:
    """The score of a text, from 0 to 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            return pa.array(np.full(len(texts), 0.5))
        bins, w, _ = model
        return pa.array(sigmoid(_scores(w, bins.columns(np.stack([features(t or "") for t in texts.to_pylist()])))))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    parts, part = HELD_OUT
    docs = id_and_text(docs)
    scored = docs.select("doc_id", score_column(trained(docs, labels, sample_rows), F.col("text")).alias("score"))
    return scored.select("doc_id", (fold("doc_id", parts) == part).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose text is predicted good; each row is decided by its own text."""
    return docs.where(score_column(trained(docs, labels, sample_rows), F.col("text")) >= THRESHOLD)
