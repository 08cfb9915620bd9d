"""Queries on tables with more rows, more of one kind or odder rows than the smallest ones, against their SQL and their rules."""

from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeworks.operators import artifacts
from lodeworks.operators import documents as documents_ops
from lodeworks.plans import registry
from lodeworks.sources import committed, payloads
from lodeworks.streaming import responses
from tests.oracle import oracle_rows, spark_rows


def same_as_oracle(spark, folder, name, **tables):
    """A query and its SQL over tables of the given names (DataFrames)."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    columns, expected = oracle_rows(con, registry.oracle_sql()[name])
    assert sorted(got.columns) == columns and spark_rows(got) == expected


def test_group_boxes_are_a_stream_over_pages(spark):
    """no group of Python for each page; pages, groups and batches meet anywhere."""
    kind = "doc_id long, page int, image_index int, width int, height int, x double, y double, w double, h double"
    rows = spark.range(30_000).select(F.floor(F.col("id") / 3).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("image_index"), F.lit(9).alias("width"), F.lit(9).alias("height"), (F.col("id") % 3 * F.when(F.col("id") < 15_000, 30).otherwise(50)).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    got = artifacts.group_boxes(spark.createDataFrame(rows.rdd, kind).repartition(3))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.groupBy("group", "members", "right").count().collect()] == [(1, 3, 70.0, 5_000)]


def documents(spark, n, text="concat('a b ', id)", source="'web'"):
    return spark.range(n).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", f"{source} AS source", "4 * id AS n_chars")


@pytest.mark.parametrize("source", ["'web'", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN ' ' ELSE 's' END"])
def test_entity_numbers_beyond_three_digits(spark, tmp_path, source):
    """as the SQL has them."""
    same_as_oracle(spark, tmp_path, "j5_number_entities", documents=documents(spark, 9_100, source=source))


def test_artifact_numbers_beyond_two_digits(spark, tmp_path):
    """as the SQL has them."""
    same_as_oracle(spark, tmp_path, "l9_artifact_names", documents=documents(spark, 9_000, text="CASE WHEN id % 2 = 0 THEN '_12_ b' WHEN id % 3 = 0 THEN '' END"))


def test_inverted_abstract_stays_in_its_row(spark, tmp_path):
    """no shuffle; rows of equal ids, no words and no text as the SQL has them."""
    texts = ["b a\n b\tc a  b", "", " \t", None, "one", "é É é", "x\x0by x"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    same_as_oracle(spark, tmp_path, "p19_inverted_abstract", documents=docs)
    got = registry.queries()["p19_inverted_abstract"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_in_pieces():
    """what a task has as Python objects is bounded, whatever a batch holds."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["aa", None, "b" * 50, "", "éé", "c" * 9, "d", None])], ["doc_id", "text"])
    found = list(documents_ops.text_pieces([batch, batch.slice(0, 0), batch.slice(6)], 10))
    assert [names for names, _ in found] == [[0, 1], [2], [3, 4], [5, 6, 7], [6, 7]]
    assert [t for _, texts in found[:4] for t in texts] == batch.column(1).to_pylist()


def test_rows_of_pieces(spark):
    """Keys of any type, null texts, texts without a row."""
    docs = spark.createDataFrame([("k1", "a\n\nb"), (None, None), ("k3", "")], "doc_id string, text string")
    assert [tuple(r) for r in documents_ops.paragraph_ranges(docs).collect()] == [("k1", 0, 1), ("k1", 3, 4), (None, 0, 0), ("k3", 0, 0)]
    assert [r["doc_id"] for r in documents_ops.chunks(docs).collect()] == ["k1"]
    assert documents_ops.chunks(docs.where("doc_id = 'k3'")).count() == 0


def test_responses_are_a_stream(spark):
    """no group of Python for each response; chunks of one meet over batches, in their order."""
    parts = ['data: {"delta":"a', 'b"}\n\n', "data: [DONE]\n\n"]
    rows = spark.range(24_000).select((F.col("id") % 8_000).cast("string").alias("resp_id"), F.floor(F.col("id") / 8_000).alias("seq"))
    chunks = rows.withColumn("chunk", F.encode(F.element_at(F.array(*map(F.lit, parts)), (F.col("seq") + 1).cast("int")), "UTF-8")).orderBy(F.desc("seq"))
    got = payloads.stream_responses(chunks)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.groupBy("status", "content", "error").agg(F.count_distinct("resp_id"), F.count("*")).collect()] == [("done", "ab", None, 8_000, 8_000)]
    assert payloads.stream_responses(chunks.where("false")).count() == 0


def test_committed_tasks_hold_little(spark, tmp_path, monkeypatch):
    """F8, F12, F14: a large batch is cut before it is held, a file is read in small batches, and all rows are there."""
    monkeypatch.setattr(committed, "HELD_BYTES", 10_000)
    monkeypatch.setattr(committed, "READ_ROWS", 7)
    schema = StructType.fromDDL("id long, kind string, content string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([f"k{i % 2}" for i in range(100)]), pa.array(["x" * 1_000] * 100)], ["id", "kind", "content"])
    sink = committed.Writer({"path": str(tmp_path), "by": "kind"}, schema, False)
    written = sink.write(iter([batch, batch.slice(0, 0)]))
    sink.commit([written])
    assert max(f["rows"] for f in written.files) <= 10
    back = list(committed._rows(str(tmp_path), schema, committed.Files(written.files)))
    assert max(b.num_rows for b in back) <= 7 and sorted(i for b in back for i in b.column("id").to_pylist()) == list(range(100))


class CountedState:
    """A state that counts its accesses."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.held if self.held is None or isinstance(self.held, tuple) else iter(self.held)
            self.held = None if name == "clear" else (self.held or []) + args[0] if name == "appendList" else args[0]

        return call


def test_accesses_do_not_grow_with_chunks():
    """each access to a state is a call out of Python; a batch makes a few of them, however many chunks wait."""
    calls, body = [], b'data: {"choices":[{"delta":{"content":"abc"}}]}\n\ndata: [DONE]\n\n'
    fold, timers = responses.FoldResponses(1_000, 1 << 20), []
    for name in ("parser", "texts", "contents", "waiting"):
        setattr(fold, name, CountedState(calls))
    fold.texts.held = fold.contents.held = fold.waiting.held = []
    fold.handle = SimpleNamespace(registerTimer=timers.append, deleteTimer=timers.remove)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = [Row(seq=i, chunk=body[i : i + 1], closed=False, at=None) for i in range(len(body))]
    assert list(fold.handleInputRows(("r",), iter(rows[1:]), now)) == [] and len(calls) < 8 and timers == [1_000]
    calls.clear()
    assert [(r.ended, r.content) for r in fold.handleInputRows(("r",), iter(rows[:1]), now)] == [("done", "abc")] and len(calls) < 10 and timers == [1_000]
