"""Scans and sinks: named Parquet tables, literal rows, validated text, keyed lookups, refusing and appending writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Literal rows, in SQL, as a table."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def valid_utf8(df: DataFrame, column: str) -> DataFrame:
    """column (binary) as text where it is valid UTF-8, null elsewhere."""
    return df.withColumn(column, F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")))


def live_entry(entries: DataFrame, key: str, now: int) -> DataFrame:
    """A cache's point lookup: the entry of a key, unless it has expired."""
    return entries.where((F.col("cache_key") == key) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def put_entries(entries: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Upsert by cache_key: new entries replace old ones and keep their created_at."""
    old = entries.select(F.col("cache_key").alias("k"), F.col("created_at").alias("first"))
    put = new.join(old, F.col("cache_key") == F.col("k"), "left").withColumn("created_at", F.coalesce("first", F.lit(now))).withColumn("updated_at", F.lit(now)).drop("k", "first")
    return entries.join(new.select(F.col("cache_key").alias("k")), F.col("cache_key") == F.col("k"), "left_anti").unionByName(put)


def write_once(df: DataFrame, path: str) -> None:
    """An artifact that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
