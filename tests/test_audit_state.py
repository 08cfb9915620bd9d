"""Snapshots: loads in sequence, nothing new, a load that fails, old files removed; reports of passes."""

import os
import tempfile

import pytest

from lodeworks.operators import audit_state, passes
from lodeworks.sources import committed

KIND = "seq long, tool string, ok boolean, at_ms long, error_kind string"


def state(spark, path):
    return {r["tool"]: tuple(r)[1:] for r in audit_state.snapshot(spark, path).collect()}


def test_loads_in_sequence(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="lodeworks-state-")
    rows = [(1, "a", True, 10, None), (2, "b", False, 20, "timeout"), (3, "a", False, 30, "parse"), (4, "a", True, 40, None), (5, "c", True, 50, None)]
    frame = lambda n: spark.createDataFrame(rows[:n], KIND)
    audit_state.load(spark, path, frame(0), 2)
    assert not committed.Folder(path).current()
    audit_state.load(spark, path, frame(2), 2)
    assert state(spark, path) == {"a": (1, 1, 0, 10, None, 1), "b": (1, 0, 1, None, 20, 1)}
    save = committed.save
    monkeypatch.setattr(committed, "save", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        audit_state.load(spark, path, frame(5), 2)
    monkeypatch.setattr(committed, "save", save)
    for _ in range(2):
        audit_state.load(spark, path, frame(5), 2)
    assert state(spark, path) == {"a": (3, 2, 1, 40, 30, 1), "b": (1, 0, 1, None, 20, 0), "c": (1, 1, 0, 50, None, 1)}
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs) == committed.manifest_files(spark, path).count() and len(os.listdir(f"{path}/_commits")) == 1


def test_pass_reports(spark):
    docs = spark.createDataFrame([(1, "a line\n\n\nb"), (2, None), (3, ""), (3, "x\n" * 5)], "doc_id long, text string")
    cleaned, report = passes.run_passes(docs, "light")
    got = {r["pass"]: tuple(r)[1:] for r in report.collect()}
    out = sum(len(r["text"]) for r in cleaned.collect())
    assert cleaned.count() == 4 and got["validate_options"][0] == "ok"
    assert got["raw_text_extraction"] == ("ok", 4, 20, 20, 0, None) and got["text_signal"] == ("ok", 4, 20, 20, 2, None) and got["text_clean"][:4] == ("ok", 4, 20, out)
    none, failed = passes.run_passes(docs, "odd")
    assert none is None and [r["status"] for r in failed.collect()] == ["failed"]
