"""Sinks and audits over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a table that must not exist yet."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Add a batch of rows, e.g. the routes of one more data set."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def require_empty(df: DataFrame, name: str) -> None:
    if not df.isEmpty():
        raise ValueError(f"table {name} already holds rows, delete them first")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Rows of both by key; on a conflict the new row wins, or with overwrite=False the existing one."""
    first, second = (new, existing) if overwrite else (existing, new)
    return second.join(first.select(*keys).distinct(), keys, "left_anti").unionByName(first, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; NULL references are allowed."""
    refs = parent.select(F.col(key).alias("_key")).distinct()
    return child.filter(F.col(column).isNotNull()).join(refs, F.col(column) == F.col("_key"), "left_anti")
