"""Scans, and the levels at which a scan can be kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cache level -> where a scan's rows stay.
LEVELS = {"none": None, "off": None, "parquet": StorageLevel.DISK_ONLY, "table_host": StorageLevel.MEMORY_AND_DISK, "table_gpu": StorageLevel.MEMORY_AND_DISK_DESER}


def scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of Parquet files; the filter and the columns reach the reader."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def cached(df: DataFrame, level: str = "table_host") -> DataFrame:
    """Keep a scan's rows; unknown levels raise KeyError."""
    storage = LEVELS[level]
    return df if storage is None else df.persist(storage)


@contextmanager
def kept(df: DataFrame, level: str = "table_host") -> Iterator[DataFrame]:
    """A scan's rows, kept as long as the block lasts."""
    stored = cached(df, level)
    try:
        yield stored
    finally:
        if stored.is_cached:
            stored.unpersist()


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The source of SELECT without FROM."""
    return spark.range(1).select()


def empty(df: DataFrame) -> DataFrame:
    """df without rows; the scan is dropped from the plan."""
    return df.where(F.lit(False))
