"""Artifacts: refused, repeated, and mended after a failure between its steps."""

import tempfile

import pytest

from lodeworks.sources import committed, sinks

KIND = "doc_id long, page long, kind string, name string, content string, status string, reason string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), KIND)


A, B, C = (1, 1, "table", "a", "x", "written", None), (1, 1, "image", "b", None, "filtered", "tiny"), (2, 1, "table", "a", "x", "written", None)


def test_saved_twice_and_refused(spark):
    path = tempfile.mkdtemp(prefix="lodeworks-artifacts-")
    for _ in range(2):
        sinks.save_artifacts(rows(spark, A, B, C), path)
    assert committed.load(spark, f"{path}/files").count() == 2 and committed.load(spark, f"{path}/decisions").count() == 3
    with pytest.raises(sinks.ArtifactsExistError, match="another content"):
        sinks.save_artifacts(rows(spark, (1, 1, "table", "a", "y", "written", None), (3, 1, "table", "new", "z", "written", None)), path)
    with pytest.raises(sinks.ArtifactsExistError, match="several contents"):
        sinks.save_artifacts(rows(spark, (4, 1, "table", "a", "y", "written", None), (4, 1, "table", "a", "z", "written", None)), path)
    assert committed.load(spark, f"{path}/files").count() == 2
    assert [r["intact"] for r in sinks.read_artifacts(spark, path).collect()] == [True, True]


def test_mended_after_a_failure_between_the_steps(spark, monkeypatch):
    path, save, calls = tempfile.mkdtemp(prefix="lodeworks-artifacts-"), committed.save, []

    def fails_once(df, where, by="", mode="append"):
        calls.append(where)
        if len(calls) == 2:
            raise OSError("lost")
        save(df, where, by, mode)

    monkeypatch.setattr(committed, "save", fails_once)
    with pytest.raises(OSError, match="lost"):
        sinks.save_artifacts(rows(spark, A, B, C), path)
    sinks.save_artifacts(rows(spark, A, B, C), path)
    assert sorted((r["doc_id"], r["name"]) for r in committed.load(spark, f"{path}/files").collect()) == [(1, "a"), (2, "a")]
    totals = {r["doc_id"]: (r["candidates"], r["written"], r["filtered"], r["errors"]) for r in sinks.artifact_totals(spark, path).where("whole = 1").collect()}
    assert totals == {1: (2, 1, 1, 0), 2: (1, 1, 0, 0)}


def test_secrets_of_any_spelling_and_depth(spark):
    from pyspark.sql import functions as F

    from lodeworks.operators.audit import redact_json

    rows = ['{"user":"a","API_KEY":"x","nested":{"access-key":"y","list":[{"Authorization":"z","ok":1}]}}', '{"plain":true,"n":null}', "no json", None]
    got = [r["p"] for r in spark.createDataFrame([(r,) for r in rows], "p string").coalesce(1).select(redact_json(F.col("p")).alias("p")).collect()]
    assert got == ['{"user":"a","API_KEY":"***","nested":{"access-key":"***","list":[{"Authorization":"***","ok":1}]}}', *rows[1:]]
