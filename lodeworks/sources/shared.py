"""Tables written in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of sessions of one process: their temporary folder.
LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where it is unset, a session of one process (master local, as in tests) gets a temporary folder; a cluster is refused,
    because each of its executors would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_ROOTS.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="lodeworks-")
        LOCAL_ROOTS[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df, written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
