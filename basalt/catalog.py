"""Tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


_schemas: dict[tuple, StructType] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files at a path; their schema, which takes a job to find, is kept as long as the path isn't written to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Read tables, and register each as a temporary view."""
    found = {name: table(spark, sf_dir, name) for name in names or TABLES}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found
