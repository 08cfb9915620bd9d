"""Toxicity and quality: held-out accuracy on the given tables, edge cases, parts of the models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import quality, toxicity
from lodeworks.llm.training import fold, training_labels

MIDDLE = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "IDIOT! you moron"), (4, "a plain and good sentence with words."), (None, "x"), (4, "a plain and good sentence with words.")]


def auc(truth, score):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for value in np.unique(score):
        same = score == value
        ranks[same] = ranks[same].mean()
    n1 = truth.sum()
    return (ranks[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(truth) - n1))


@pytest.mark.parametrize("run, label, parts, part, least", [(toxicity.toxicity_scores, "toxic", 5, 0, 0.93), (quality.quality_scores, "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, run, label, parts, part, least):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = run(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").toPandas()
    expected = got["doc_id"].map(lambda d: __import__("zlib").crc32(str(d).encode()) % parts == part)
    assert (got["held_out"] == expected).all()
    assert got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) > least
    assert ((held["predicted"] == held[label]).mean()) > 0.95


@pytest.mark.parametrize("run, label", [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("labelled", [[], [(3, 1), (4, 0), (2, None), (9, 1), (3, 1), (1, 0), (1, 1)]])
def test_odd_rows(spark, run, label, rows, labelled):
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, pattern int")
    out = run(docs, spark.createDataFrame(labelled, f"doc_id long, {label} int")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 4]
    assert len(set(same)) <= 1


def test_labels_of_the_held_out_fold_are_never_read(spark):
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    used = training_labels(labels, "toxic", 5, 0)
    assert used.where(fold("label_doc", 5) == 0).count() == 0 and used.count() > 700
    assert training_labels(labels, "toxic", 5, 0, most=100).count() < 160


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.1
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.03, 0.8]])
    votes = np.stack([rng.random(len(truth)) < np.where(truth, b, a) for a, b in rates], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter that repeats the first
    votes = votes.astype(float)
    model = toxicity.LabelModel(votes.mean(axis=0), votes.T @ votes / len(votes), 0.2)
    for _ in range(toxicity.ROUNDS):
        model.update(model.expected(votes, np.ones(len(votes))))
    assert abs(model.prior - 0.1) < 0.02
    assert np.abs(model.rates[1][:4] - rates[:, 1]).max() < 0.15  # 0.3 if the repeated voter is believed twice
    assert model.correlations[0, 4] > 0.4 and model.correlations[1, 2] < 0.15
    assert model.discount[0] < 0.75 < model.discount[2]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_the_label_model_of_spark_equals_the_local_one(spark):
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.2
    votes = (rng.random((3000, 6)) < np.where(truth[:, None], 0.6, 0.03)).astype(float)
    patterns = (votes.astype(int) << np.arange(6)).sum(axis=1)
    rows = [(2, int(p), int(n)) for p, n in zip(*np.unique(patterns, return_counts=True))]
    models = toxicity.label_models(spark.createDataFrame(rows, "length long, pattern long, n long").repartition(3), 6)
    got, local = models[2], toxicity.LabelModel(votes.mean(axis=0), votes.T @ votes / len(votes))
    for _ in range(toxicity.ROUNDS):
        local.update(local.expected(votes, np.ones(len(votes))))
    assert abs(got.prior - local.prior) < 1e-9 and np.abs(got.rates - local.rates).max() < 1e-9 and abs(got.prior - 0.2) < 0.05


@pytest.mark.parametrize("run, label", [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_very_long_texts(spark, run, label):
    """A text of millions of characters is read whole: its end counts."""
    plain = "a plain and good sentence with words. " * 60_000
    docs = spark.createDataFrame([(1, plain), (2, plain + " idiot moron scum"), (3, "x" * 3_000_000), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in run(docs, spark.createDataFrame([], f"doc_id long, {label} int")).collect()}
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out.values())
    if label == "toxic":
        assert out[2]["n_cues"] == 3 and out[1]["n_cues"] == 0


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(2, 1, (20_000, 1)), rng.normal(-2, 1, (20_000, 1))
    mixed = np.where(rng.random((20_000, 1)) < 0.7, rng.normal(2, 1, (20_000, 1)), negative)
    bins, w, prior = quality.fit(positive, mixed)
    assert abs(prior - 0.7) < 0.05
    score = lambda x: quality.sigmoid(quality._scores(w, bins.columns(x)))
    assert (score(positive) > 0.7).mean() > 0.93 and (score(negative) < 0.7).mean() > 0.93


@pytest.mark.parametrize("ids", ["5", "cast(null as bigint)", "id"])
def test_samples_are_drawn_row_by_row(spark, ids):
    """50,000 rows of one id, without id, or with ids of their own: about as many as asked for, and a bound that holds."""
    from lodeworks.llm.training import SLACK, row_sample

    rows = spark.range(50_000, numPartitions=5).selectExpr(f"{ids} AS doc_id", "id AS n")
    n = row_sample(rows, 20_000).count()
    assert 18_000 < n < 22_000 and n <= 20_000 * SLACK
    assert row_sample(rows, 60_000).count() == 50_000
