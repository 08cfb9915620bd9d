"""A data source of committed folders: rows are there once a manifest names their files, all of a write at once or none.

    register(spark)
    captures.write.format("committed").option("by", "provider,kind").mode("append").save(path)
    load(spark, path, provider="openalex", kind=["get", "search"])

A task writes Parquet files below folders of the `by` columns' values; the driver then adds one numbered manifest, by a link that
fails if the number is taken, so what a lost task or a failed job leaves is never read.  A stream names itself
(option stream): a micro-batch that comes again finds its manifest and its files are dropped.  Readers plan from manifests: what is asked
of the `by` columns (option only) chooses files before any is opened, small files share a partition.  With option
pushdown (and spark.sql.python.filterPushdown.enabled) Spark's own filters choose them too; that is not the default, because Spark 4.1 then plans all
scans of one DataFrame with the filters of the last, so two filtered uses of one load would read the same files.  A stream's offset is the number of the last manifest.
"""

from __future__ import annotations

import contextlib
import json
import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COMMITS = "_commits"
#: Bytes of files in a read partition; bytes that a task holds before it writes files.
PARTITION_BYTES, HELD_BYTES = 32 << 20, 16 << 20
#: Rows that a reader turns to Arrow at once.
READ_ROWS = 4_096


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CommittedFolder)


class Folder:
    """A folder in any store that Arrow reaches by its address, and its manifests."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            path = "file://" + path.removeprefix("file:").removeprefix("//")
        self.store, self.root = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
        self.root = self.root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def manifests(self, after: int = 0, until: int | None = None) -> list[tuple[int, dict]]:
        """(number, manifest) in order; after the last one that replaces everything, unless a range is asked for."""
        listed = self.store.get_file_info(pafs.FileSelector(self.at(COMMITS), allow_not_found=True))
        numbers = sorted(int(i.base_name[:-5]) for i in listed if i.base_name.endswith(".json"))
        found = []
        for n in numbers:
            if n > after and (until is None or n <= until):
                with self.store.open_input_stream(self.at(COMMITS, f"{n:012d}.json")) as f:
                    found.append((n, json.loads(f.read())))
        return found

    def current(self) -> list[dict]:
        kept: list[dict] = []
        for _, m in self.manifests():
            kept = [m] if m["replaces"] else [*kept, m]
        return kept

    def commit(self, manifest: dict) -> bool:
        """Add a manifest under the next number; False if it is a stream's batch that has been committed."""
        self.store.create_dir(self.at(COMMITS))
        body = json.dumps(manifest).encode()
        while True:
            known = self.manifests()
            if manifest["stream"] and any((m["stream"], m["batch"]) == (manifest["stream"], manifest["batch"]) for _, m in known):
                return False
            name = self.at(COMMITS, f"{(known[-1][0] if known else 0) + 1:012d}.json")
            draft = self.at(COMMITS, f".{uuid.uuid4().hex}")
            with self.store.open_output_stream(draft) as f:
                f.write(body)
            try:
                if isinstance(self.store, pafs.LocalFileSystem):
                    os.link(draft, name)
                elif self.store.get_file_info(name).type != pafs.FileType.NotFound:
                    raise FileExistsError(name)
                else:
                    self.store.copy_file(draft, name)
            except FileExistsError:
                continue
            finally:
                self.store.delete_file(draft)
            return True

    def drop(self, files: list[dict]) -> None:
        for f in files:
            with contextlib.suppress(FileNotFoundError):
                self.store.delete_file(self.at(f["path"]))


def _holds(f: ds.Filter, values: dict) -> bool | None:
    """Whether a filter holds for a file's values; None if they do not say."""
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in values:
        return None
    v = values[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return v is None
    if isinstance(f, ds.EqualNullSafe):
        return v == f.value
    if isinstance(f, ds.IsNotNull):
        return v is not None
    tests = {
        ds.EqualTo: lambda: v == f.value, ds.In: lambda: v in f.value, ds.GreaterThan: lambda: v > f.value, ds.GreaterThanOrEqual: lambda: v >= f.value, ds.LessThan: lambda: v < f.value,
        ds.LessThanOrEqual: lambda: v <= f.value, ds.StringStartsWith: lambda: v.startswith(f.value), ds.StringEndsWith: lambda: v.endswith(f.value), ds.StringContains: lambda: f.value in v,
    }
    return None if type(f) not in tests else v is not None and tests[type(f)]()


@dataclass
class Files(ds.InputPartition):
    files: list[dict]


def _planned(files: list[dict], most: int) -> list[Files]:
    """Files in partitions of about `most` bytes."""
    out, held, size = [], [], 0
    for f in files:
        if held and size + f["bytes"] > most:
            out.append(Files(held))
            held, size = [], 0
        held.append(f)
        size += f["bytes"]
    return [*out, Files(held)] if held else out


def _rows(path: str, schema: StructType, partition: Files | None) -> Iterator[pa.RecordBatch]:
    folder, wanted = Folder(path), to_arrow_schema(schema)
    for f in partition.files if partition is not None else []:
        with folder.store.open_input_file(folder.at(f["path"])) as source:
            parquet = pq.ParquetFile(source)
            names = [n for n in parquet.schema_arrow.names if n in wanted.names]
            for batch in parquet.iter_batches(READ_ROWS, columns=names):
                have = {**{n: pa.nulls(batch.num_rows, wanted.field(n).type) for n in wanted.names}, **dict(zip(names, batch.columns)), **{k: pa.array([v] * batch.num_rows, wanted.field(k).type) for k, v in f["values"].items() if k in wanted.names}}
                yield pa.RecordBatch.from_arrays([have[n].cast(wanted.field(n).type) for n in wanted.names], schema=wanted)


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.most = options["path"], schema, int(options.get("partition_bytes", PARTITION_BYTES))
        self.only = json.loads(options.get("only", "{}"))
        self.filters: list[ds.Filter] = []

    def partitions(self) -> list[Files]:
        files = [f for m in Folder(self.path).current() for f in m["files"] if all(_holds(x, f["values"]) is not False for x in self.filters)]
        files = [f for f in files if all(c not in f["values"] or f["values"][c] in wanted for c, wanted in self.only.items())]
        return _planned(files, self.most)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, self.schema, partition)


class FilteringReader(Reader):
    """Takes filters on the `by` columns from Spark."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        by = {c: "" for m in Folder(self.path).current() for c in m["by"]}
        for f in filters:
            known = hasattr(f, "attribute") and len(f.attribute) == 1 and f.attribute[0] in by and not isinstance(f, ds.Not)
            if known:
                self.filters.append(f)
            else:
                yield f


class StreamReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.most = options["path"], schema, int(options.get("partition_bytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        known = Folder(self.path).manifests()
        return {"commit": known[-1][0] if known else 0}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _planned([f for _, m in Folder(self.path).manifests(start["commit"], end["commit"]) for f in m["files"]], self.most)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, self.schema, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class _Sink:
    """What batch and stream writers share."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.schema, self.replaces, self.stream = options["path"], schema, overwrite, options.get("stream")
        self.by = [c.strip() for c in options.get("by", "").split(",") if c.strip()]
        if missing := [c for c in self.by if c not in schema.names]:
            raise ValueError(f"no such columns to deal files by: {missing}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, held, size, files = Folder(self.path), [], 0, []

        def flush() -> None:
            table = pa.Table.from_batches(held)
            rows: dict[tuple, list[int]] = {}
            for i, values in enumerate(zip(*(table.column(c).to_pylist() for c in self.by))) if self.by else ():
                rows.setdefault(values, []).append(i)
            for values, places in rows.items() if self.by else [((), None)]:
                where = "/".join([*(f"{c}={urllib.parse.quote(str(v), safe='')}" for c, v in zip(self.by, values)), f"{uuid.uuid4().hex}.parquet"])
                folder.store.create_dir(folder.at(*where.split("/")[:-1]))
                part = (table if places is None else table.take(pa.array(places))).drop_columns(self.by)
                with folder.store.open_output_stream(folder.at(where)) as out:
                    pq.write_table(part, out, compression="zstd")
                files.append({"path": where, "values": dict(zip(self.by, values)), "rows": part.num_rows, "bytes": folder.store.get_file_info(folder.at(where)).size})

        for batch in batches:
            step = max(1, batch.num_rows * HELD_BYTES // max(1, 4 * batch.nbytes))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size > HELD_BYTES:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return Written(files)

    def finish(self, messages: list[Written | None], batch: int | None) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        manifest = {"by": self.by, "schema": self.schema.json(), "replaces": self.replaces and batch is None, "stream": self.stream if batch is not None else None, "batch": batch, "files": files}
        folder = Folder(self.path)
        if not folder.commit(manifest):
            folder.drop(files)

    def undo(self, messages: list[Written | None]) -> None:
        Folder(self.path).drop([f for m in messages if m is not None for f in m.files])


class Writer(_Sink, ds.DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self.undo(messages)


class StreamWriter(_Sink, ds.DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        if not self.stream:
            raise ValueError("a stream that writes to a committed folder needs a name (option stream)")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.finish(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.undo(messages)


class CommittedFolder(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> StructType:
        known = Folder(self.options["path"]).current()
        if not known:
            raise ValueError(f"nothing has been committed to {self.options['path']}")
        return StructType.fromJson(json.loads(known[-1]["schema"]))

    def reader(self, schema: StructType) -> Reader:
        return (FilteringReader if self.options.get("pushdown") == "true" else Reader)(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, schema, overwrite)


def save(df: DataFrame, path: str, by: str = "", mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("committed").option("by", by).mode(mode).save(path)


def load(spark: SparkSession, path: str, **only) -> DataFrame:
    """The folder's rows; only: for columns, the value or list of values that rows must have.  Files of other values are not opened."""
    register(spark)
    wanted = {c: v if isinstance(v, list) else [v] for c, v in only.items()}
    rows = spark.read.format("committed").option("only", json.dumps(wanted)).load(path)
    for c, values in wanted.items():
        known = [v for v in values if v is not None]
        rows = rows.where((F.col(c).isin(*known) if known else F.lit(False)) | (F.col(c).isNull() if None in values else F.lit(False)))
    return rows


def vacuum(path: str) -> int:
    """Delete what was replaced: files and manifests before the last one that replaces everything; their number.  For folders that no stream reads."""
    folder, kept = Folder(path), {f["path"] for m in Folder(path).current() for f in m["files"]}
    known = folder.manifests()
    last = max((n for n, m in known if m["replaces"]), default=0)
    gone = [f for n, m in known if n < last for f in m["files"] if f["path"] not in kept]
    folder.drop(gone)
    for n, _ in known:
        if n < last:
            folder.store.delete_file(folder.at(COMMITS, f"{n:012d}.json"))
    return len(gone)


MANIFEST = "files array<struct<path: string, rows: long, bytes: long, values: map<string, string>>>, stream string, batch long"


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """commit, stream, batch, path, rows, bytes, values of each file that manifests name, without opening the files."""
    read = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/{COMMITS}/*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("commit"), "stream", "batch", F.explode("files").alias("f"))
    return read.select("commit", "stream", "batch", "f.*")
