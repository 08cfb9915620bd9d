"""Committed folders: whole writes or none, pruned reads, streams from and to them."""

import datetime
import json
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.sources import committed
from lodeworks.sources.committed import Folder, Reader, StreamWriter, _planned, load, manifest_files, register, save


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="lodeworks-committed-") + "/folder"


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id"), F.concat(F.lit("p"), F.col("id") % 3).alias("provider"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k/ü "), F.col("id") % 2)).alias("kind"), F.lit("text").alias("raw"), F.lit(datetime.datetime(2024, 1, 2)).alias("at")).repartition(3)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_appends_overwrites_and_types(spark, path):
    save(rows(spark, 20), path, by="provider,kind")
    save(rows(spark, 10, 100), path, by="provider,kind")
    df = load(spark, path)
    assert df.dtypes == [("id", "bigint"), ("provider", "string"), ("kind", "string"), ("raw", "string"), ("at", "timestamp")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, rows(spark, 20).unionAll(rows(spark, 10, 100)).collect()), key=repr)
    assert manifest_files(spark, path).agg(F.sum("rows")).first()[0] == 30
    save(rows(spark, 5), path, by="provider", mode="overwrite")
    assert ids(load(spark, path)) == list(range(5))


@pytest.mark.parametrize(
    "condition, files",
    [("provider = 'p1'", 3), ("provider in ('p0', 'p2')", 6), ("kind is null", 3), ("kind is not null and provider = 'p0'", 2), ("kind <=> null", 3), ("provider = 'p1' and id > 8", 3), ("kind like '%ü 1'", 3), ("kind like 'k/%'", 6), ("provider >= 'p1'", 6), ("not (provider = 'p1')", 9), ("provider = 'none'", 0), ("provider = 'p0' or id = 1", 9)],
)
def test_filters_choose_files(spark, path, condition, files):
    """A file for each pair of values; a partition for each file."""
    save(rows(spark, 60).coalesce(1), path, by="provider,kind")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("committed").option("partition_bytes", "1").option("pushdown", "true").load(path).where(condition)
        assert ids(df) == ids(rows(spark, 60).where(condition))
        assert df.rdd.getNumPartitions() == max(files, 1 if files == 0 and df.rdd.getNumPartitions() else files)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("only, condition, files", [({"provider": "p1"}, "provider = 'p1'", 3), ({"provider": ["p0", "p2"], "kind": "k/ü 1"}, "provider in ('p0', 'p2') and kind = 'k/ü 1'", 2), ({"kind": None}, "kind is null", 3), ({"kind": [None, "k/ü 0"]}, "kind is null or kind = 'k/ü 0'", 6), ({"raw": "none"}, "false", 9)])
def test_values_choose_files(spark, path, only, condition, files):
    save(rows(spark, 60).coalesce(1), path, by="provider,kind")
    df = load(spark, path, **only)
    assert ids(df) == ids(rows(spark, 60).where(condition))
    assert len(Reader({"path": path, "partition_bytes": "1", "only": json.dumps({c: v if isinstance(v, list) else [v] for c, v in only.items()})}, df.schema).partitions()) == files


def test_two_filtered_uses_of_one_load(spark, path):
    save(rows(spark, 60), path, by="provider")
    df = load(spark, path)
    both = df.where("provider = 'p0'").unionAll(df.where("provider = 'p1'"))
    assert ids(both) == [i for i in range(60) if i % 3 < 2]


def test_a_failed_write_is_never_read(spark, path):
    save(rows(spark, 6), path)
    broken = rows(spark, 100).withColumn("raw", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="stop"):
        save(broken, path)
    assert ids(load(spark, path)) == list(range(6))


def test_nothing_committed_and_bad_columns(spark, path):
    register(spark)
    with pytest.raises(Exception, match="nothing has been committed"):
        load(spark, path)
    with pytest.raises(Exception, match="no such columns"):
        save(rows(spark, 1), path, by="none")
    save(rows(spark, 0), path)
    assert ids(load(spark, path)) == []


def test_a_number_is_taken_once(path):
    folder = Folder(path)
    manifest = {"by": [], "schema": "{}", "replaces": False, "stream": None, "batch": None, "files": []}
    assert folder.commit(manifest) and folder.commit(manifest)
    assert [n for n, _ in folder.manifests()] == [1, 2]
    assert sorted(os.listdir(f"{path}/_commits")) == ["000000000001.json", "000000000002.json"]


def test_a_batch_that_comes_again_counts_once(spark, path):
    """The protocol itself: the same batch of the same stream, written twice, with other files."""
    schema = spark.range(1).schema
    for stream, batch in (("s", 0), ("s", 0), ("s", 1), ("t", 0)):
        sink = StreamWriter({"path": path, "stream": stream}, schema, False)
        sink.commit([sink.write(iter([pa.record_batch({"id": pa.array([batch], pa.int64())})])), None], batch)
    assert ids(load(spark, path)) == [0, 0, 1]
    on_disk = sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)
    assert on_disk == 3
    with pytest.raises(ValueError, match="needs a name"):
        StreamWriter({"path": path}, schema, False)


def test_streams_from_and_to_folders(spark, path):
    """Three appends read by a stream that is started for each; its rows go to another folder, once, also if its progress is lost."""
    register(spark)
    target = path + "-out"

    def run(progress):
        stream = spark.readStream.format("committed").load(path).select("id", "provider")
        stream.writeStream.format("committed").option("path", target).option("by", "provider").option("stream", "copy").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        save(rows(spark, 7, 10 * k), path, by="provider")
        run(path + "-progress")
    assert ids(load(spark, target)) == [10 * k + i for k in range(3) for i in range(7)]
    run(path + "-new-progress")
    assert len(ids(load(spark, target))) >= 21
    assert {json.loads(json.dumps(r["values"]))["provider"] for r in manifest_files(spark, target).collect()} == {"p0", "p1", "p2"}


def test_small_files_share_a_partition():
    files = [{"bytes": b} for b in (5, 5, 5, 20, 1)]
    assert [[f["bytes"] for f in p.files] for p in _planned(files, 10)] == [[5, 5], [5], [20], [1]]
    assert _planned([], 10) == [] and committed.PARTITION_BYTES > 0
