"""Toxicity by weak supervision.

Cues are words and word beginnings.  They are mined from labelled training rows by smoothed log odds (at most MOST_CUES,
the best by odds and frequency), and a fixed list of insults is added; labels are used for nothing else.  Some 30
voters look at a text: lexicons (groups of word cues, dealt by rank), beginnings (groups of word beginnings of one
length), the fixed list, and patterns of form: shouting, exclamations, an insult behind an address.  A voter votes toxic or
abstains.

A generative label model - a latent class with a vote probability for each voter and class - takes its start from
the moments of the votes of all documents.  Were voters independent within the classes, their covariances would be
products of one number each, which triplets of voters give (a lower quartile: voters that repeat each other inflate
them); that number is a voter's accuracy, and what a pair's covariance has beyond the product is its correlation.  A voter's evidence is
divided by the voters that its own repeats.  Rounds of expectation maximisation over the counts of vote patterns of all documents
then settle the class's share and the rates; each round is a Spark job that returns one number a voter.  A short text gives a
voter little to see, so its silence says little: there is a model for each of four classes of length.

A linear classifier on cue presence is trained on the posteriors, and on nothing else, of a bounded sample of
documents, and scores every document.  Labels, lang, source and doc_id are never features.

Defined cases: null and empty texts have no cues and get the classifier's base score; repeated rows are
scored alike; without usable labels only the fixed list and the patterns of form vote; an empty table gives an empty
result; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import id_and_text, materialize
from lodeworks.llm.training import SAMPLE_ROWS, bounded, descend, fold, row_sample, sigmoid, training_labels

HELD_OUT = (5, 0)
MOST_CUES, LEAST_DOCS, LEAST_ODDS = 2000, 4, 3.5
BEGINNINGS = (3, 4, 5)
GROUPS, BEGINNING_GROUPS = 12, 4  # lexicons; voters of each length of beginnings
FORMS = ["shouting", "exclamations", "address"]
ROUNDS = 20
LENGTHS = (30, 100, 300)  # words: bounds of the classes of length
EDGES = ".,;:!?\"'()[]{}<>*#|-_"
#: Common insults.
INSULTS = "asshole bastard bitch clown cretin cunt disgusting dumb fool idiot imbecile jerk loser moron pathetic scum shit stupid trash worthless".split()


def cues_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _words(texts: pa.Array):
    """offsets, codes, distinct words (lower case, without punctuation around them) of a batch of texts."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy(), coded.indices.to_numpy(), [w.strip(EDGES) for w in coded.dictionary.to_pylist()]


ADDRESS = rf"\b(you|your|youre|du|ihr|tu|vous|usted)\b[^.!?]{{0,20}}\b({'|'.join(INSULTS)})"


def form_votes(texts: pa.Array) -> np.ndarray:
    """(texts, FORMS) votes."""
    shouting = pc.greater_equal(pc.count_substring_regex(texts, r"\b[A-Z]{3,}\b"), 3)
    exclamations = pc.greater_equal(pc.count_substring(texts, "!!"), 2)
    address = pc.match_substring_regex(pc.utf8_lower(texts), ADDRESS)
    return np.stack([v.to_numpy(zero_copy_only=False).astype(bool) for v in (shouting, exclamations, address)], axis=1)


@dataclass
class Cues:
    names: list[str]
    voters: list[str] = field(default_factory=list)
    voter_of: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Voters: the fixed list, groups of words, groups of beginnings, forms; cues are dealt by rank, those of the fixed list only to it."""
        fixed, seen = set(INSULTS), Counter()
        self.voters = ["insults", *(f"words {g}" for g in range(GROUPS)), *(f"beginnings of {n}, {g}" for n in BEGINNINGS for g in range(BEGINNING_GROUPS)), *FORMS]
        for name in self.names:
            if name in fixed:
                self.voter_of[name] = 0
                continue
            kind = len(name) - 1 if name.endswith("*") else 0
            first, groups = (1 + GROUPS + BEGINNINGS.index(kind) * BEGINNING_GROUPS, BEGINNING_GROUPS) if kind else (1, GROUPS)
            self.voter_of[name] = first + seen[kind] % groups
            seen[kind] += 1
        self.number = {c: i for i, c in enumerate(self.names)}
        self.bits = np.array([1 << self.voter_of[c] for c in self.names], np.int64)

    def found(self, texts: pa.Array) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """The numbers of the cues in each text, ascending; the votes as bits; the class of length."""
        if not len(texts):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets, codes, words = _words(texts)
        number = self.number
        hits = {i: n for i, w in enumerate(words) if (n := [number[c] for c in cues_of(w) if c in number])}
        out: list[set[int]] = [set() for _ in range(len(texts))]
        if hits:
            places = np.flatnonzero(np.isin(codes, np.fromiter(hits, np.int64, len(hits))))
            for doc, code in zip((np.searchsorted(offsets, places, "right") - 1).tolist(), codes[places].tolist()):
                out[doc].update(hits[code])
        cues = [sorted(s) for s in out]
        first_form = len(self.voters) - len(FORMS)
        pattern = (form_votes(texts).astype(np.int64) << (first_form + np.arange(len(FORMS)))).sum(axis=1)
        length = np.searchsorted(LENGTHS, np.diff(offsets), "right")
        return cues, pattern | np.array([np.bitwise_or.reduce(self.bits[c]) if c else 0 for c in cues], np.int64), length


def mine_cues(labelled: DataFrame) -> list[str]:
    """labelled (text, label; a bounded sample) -> cues by smoothed log odds, the fixed list last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = {w.strip(EDGES) for w in text.lower().split()}
                (toxic if label else other).update({c for w in words if w for c in cues_of(w)})
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[c] for c in names], pa.int64()), pa.array([other[c] for c in names], pa.int64())], ["cue", "toxic", "other"])

    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return list(INSULTS)
    counted = labelled.select("text", "label").mapInArrow(count, "cue string, toxic long, other long").groupBy("cue").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= LEAST_DOCS)
    odds = F.log((F.col("toxic") + 0.1) / (sizes[1] + 0.2)) - F.log((F.col("other") + 0.1) / (sizes[0] + 0.2))
    best = counted.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "cue").limit(MOST_CUES)
    mined = [r["cue"] for r in best.collect()]
    return mined + [w for w in INSULTS if w not in set(mined)]


def as_votes(patterns, n_voters: int) -> np.ndarray:
    return (np.asarray(patterns, np.int64)[:, None] >> np.arange(n_voters) & 1).astype(float)


class LabelModel:
    """Latent class model of votes, from their moments: share (voters) of documents with a vote, both (voters, voters) with two votes."""

    def __init__(self, share: np.ndarray, both: np.ndarray, prior: float = 0.1) -> None:
        self.prior, self.cov = prior, both - np.outer(share, share)
        strength, self.correlations = self._moments()
        self.discount = 1 / (1 + self.correlations.sum(axis=1))
        gap = strength / math.sqrt(prior * (1 - prior))  # of the rates of the two classes
        self._set(share - prior * gap, share + (1 - prior) * gap)

    def _set(self, clean: np.ndarray, toxic: np.ndarray) -> None:
        self.rates = np.clip(np.stack([clean, toxic]), 1e-4, 1 - 1e-4)
        self.rates[1] = np.maximum(self.rates[1], self.rates[0])  # a vote never speaks for clean

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0]) * self.discount
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.discount
        return math.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(votes.astype(float)))

    def expected(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What a round adds up over rows: documents, toxic ones, votes of each voter, toxic ones of these."""
        p = self.posterior(votes) * weight
        return np.concatenate([[weight.sum(), p.sum()], weight @ votes, p @ votes])

    def update(self, sums: np.ndarray) -> None:
        """The other half of a round."""
        n, toxic, (votes, toxic_votes) = sums[0], sums[1], sums[2:].reshape(2, -1)
        self.prior = float(np.clip((toxic + 1) / (n + 2), 1e-3, 0.5))
        self._set((votes - toxic_votes + 0.5) / (n - toxic + 50), (toxic_votes + 0.5) / (toxic + 1))

    def _moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Each voter's strength; correlations beyond what a shared class explains, from 0 to 1, zero on the diagonal."""
        cov = self.cov
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        n = len(sd)
        strength = np.zeros(n)
        for i in range(n):
            triplets = [cov[i, j] * cov[i, k] / cov[j, k] for j in range(n) for k in range(j + 1, n) if i not in (j, k) and cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0]
            strength[i] = math.sqrt(min(float(np.quantile(triplets, 0.25)), sd[i] ** 2)) if triplets else 0
        beyond = np.clip((cov - np.outer(strength, strength)) / np.outer(sd, sd), 0, 1)
        beyond[np.diag(cov) < 1e-9] = 0
        beyond[:, np.diag(cov) < 1e-9] = 0
        np.fill_diagonal(beyond, 0)
        return strength, beyond


def train_classifier(cues: list[list[int]], soft: np.ndarray, n_cues: int, l2: float = 1e-4) -> np.ndarray:
    """Weights of the cues and, last, the base, of logistic regression on soft labels."""
    row = np.repeat(np.arange(len(cues)), [len(c) for c in cues])
    col = np.array([x for c in cues for x in c], np.int64)

    def gradient(w: np.ndarray) -> np.ndarray:
        error = sigmoid(np.bincount(row, w[col], len(cues)) + w[-1]) - soft
        g = np.append(np.bincount(col, error[row], n_cues), error.sum()) / max(1, len(cues))
        return g + l2 * np.append(w[:-1], 0)

    return descend(gradient, n_cues + 1)


def posteriors(models: list[LabelModel], length: np.ndarray, patterns: np.ndarray, n_voters: int) -> np.ndarray:
    out = np.zeros(len(length))
    for k, model in enumerate(models):
        here = length == k
        out[here] = model.posterior(as_votes(patterns[here], n_voters))
    return out


def label_models(patterns: DataFrame, n_voters: int) -> list[LabelModel]:
    """A model for each class of length, of vote patterns (length, pattern, n), over all of them; only sums of fixed size come to the driver."""
    classes = range(len(LENGTHS) + 1)

    def total(of, size: int) -> np.ndarray:
        """(classes, size): the sums of of(class, votes, weights) over all patterns; one row a partition and number, added up by tasks."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(classes), size))
            for batch in batches:
                length, pattern, n = (batch.column(c).to_numpy() for c in ("length", "pattern", "n"))
                for k in classes:
                    here = length == k
                    out[k] += of(k, as_votes(pattern[here], n_voters), n[here].astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], ["i", "x"])

        out = np.zeros(len(classes) * size)
        for r in patterns.mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out.reshape(len(classes), size)

    sums = total(lambda k, v, w: np.append(((v * w[:, None]).T @ v).ravel(), w.sum()), n_voters**2 + 1)
    models = []
    for row in sums:
        both = row[:-1].reshape(n_voters, n_voters) / max(1.0, row[-1])
        models.append(LabelModel(np.diag(both).copy(), both))
    for _ in range(ROUNDS):
        sums = total(lambda k, v, w: models[k].expected(v, w), 2 + 2 * n_voters)
        for model, row in zip(models, sums):
            model.update(row)
    return models


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_cues, label_model (the label model's posterior)."""
    parts, part = HELD_OUT
    docs = id_and_text(docs)
    known = materialize(training_labels(labels, "toxic", parts, part, sample_rows), "toxic-labels")
    # At most sample_rows labels: a bounded side.
    cues = Cues(mine_cues(docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_doc"))))
    n_voters = len(cues.voters)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, pattern, length = cues.found(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(length, pa.int64()), pa.array(pattern), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "length", "pattern", "cues"])

    votes = materialize(docs.mapInArrow(find, "doc_id long, length long, pattern long, cues array<int>"), "toxic-votes")
    models = label_models(materialize(votes.groupBy("length", "pattern").agg(F.count("*").alias("n")), "vote-patterns"), n_voters)
    sample = bounded(row_sample(votes, 2 * sample_rows).select("length", "pattern", "cues"), 2 * sample_rows).toPandas()
    soft = posteriors(models, sample["length"].to_numpy(np.int64), sample["pattern"].to_numpy(np.int64), n_voters)
    weights = train_classifier([list(c) for c in sample["cues"]], soft, len(cues.names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cues")
            lengths = pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            flat = lists.flatten().to_numpy().astype(np.int64)
            value = sigmoid(np.bincount(row, weights[flat], batch.num_rows) + weights[-1])
            post = posteriors(models, batch.column("length").to_numpy(), batch.column("pattern").to_numpy(), n_voters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(lengths.astype(np.int64)), pa.array(post)], ["doc_id", "score", "n_cues", "label_model"])

    scored = votes.mapInArrow(score, "doc_id long, score double, n_cues long, label_model double")
    return scored.select("doc_id", (fold("doc_id", parts) == part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_cues", "label_model")
