"""What the operators share: the shared folder, written tables, row batches of bounded size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset and all run on this machine (as in tests), one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return re.sub("^file:/(?!/)", "file:///", whole)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="basalt-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path has named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a written table that is done with."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def cleared(spark: SparkSession, kept: list[DataFrame] | None = None) -> Iterator[None]:
    """What operators write inside is deleted at the end, so write or collect results inside.

    Written tables that are put in `kept` stay; they belong to the scope around this one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        own = _scopes.pop()
        stay = [p for df in kept or [] for p in own if any(p.rsplit("/", 1)[-1] in f for f in df.inputFiles()[:1])]
        for path in own:
            if path not in stay:
                remove(spark, path)
        if _scopes:
            _scopes[-1].extend(stay)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(documents: DataFrame, column: str = "text", each: int = 8 << 20) -> int:
    """How many buckets the documents' texts are dealt to, at most so many bytes in the mean: a task's memory doesn't grow with the input."""
    size = documents.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0]
    return max(2 * partitions(documents.sparkSession), -(-(size or 0) // each))


def by_bucket(df: DataFrame, buckets: int) -> GroupedData:
    """Rows by the bucket in `part` (an int), a task a bucket."""
    return df.repartitionById(buckets, "part").groupBy("part")


def release_memory() -> None:
    """Give freed memory back: workers live on and share their executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` bytes of a string column, or one row."""
    try:
        yield from _pieces(batches, column, most)
    finally:
        release_memory()


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        bounds = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; of a written table that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def connected_components(edges: DataFrame, small: int = 2 << 20) -> DataFrame:
    """Nodes of `edges` (u, v of one ordered type) with the smallest node that can be reached: columns u, root.

    Each round gives every node its smallest smaller neighbour as a parent, joins its other smaller neighbours to that parent
    and then skips a generation.  Every round brings some node nearer to its root, so it ends whatever the graph is; edges stay as many at
    most.  Parents come from partly aggregated minima.  Those of at most `small` bytes of written edges are broadcast.  Others are written first, so
    both sides of a join on a parent that a third of all nodes may have come from a shuffle, and adaptive execution can split
    it.  Tables of earlier rounds are deleted.  Null nodes and loops are left out.
    """
    spark = edges.sparkSession
    with cleared(spark, kept := []):
        edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
        more = True
        while more:
            with cleared(spark, now := []):
                parent = edges.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n"))
                fits = estimated_bytes(edges) <= small
                parent, other = (parent, F.broadcast) if fits else (written(parent, "parents"), lambda df: df)
                up = other(parent.select(F.col("u").alias("p"), F.col("p").alias("pp")))
                grand = parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.lit(0).alias("more"), (F.col("pp").isNotNull() | (F.col("n") > 1)).alias("moved"))
                rest = edges.join(other(parent.where("n > 1").select("u", "p")), "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(1).alias("more"), F.lit(True).alias("moved"))
                moved = Observation()
                after = written(grand.unionByName(rest).groupBy("u", "v").agg(F.min("more").alias("more"), F.max("moved").alias("moved")).observe(moved, F.max("moved").alias("any")), "edges")
                more = bool(moved.get["any"])
                before, edges = edges, after.select("u", "v")
                now.append(after)
            discard(before)
        kept.append(after)
        return edges.select("u", F.col("v").alias("root"))
