"""The Spark session, with the engine's options by their meaning.

Sizes are what one task should hold; the number of partitions then follows the data by adaptive
execution, so the same settings serve 60 thousand rows and 100 TB.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}

#: Option -> the Spark settings that it sets.
OPTIONS: dict[str, tuple[str, ...]] = {
    "scan_task_batch_size": ("spark.sql.files.maxPartitionBytes",),
    "hash_partition_bytes": ("spark.sql.adaptive.advisoryPartitionSizeInBytes",),
    "concat_batch_bytes": ("spark.sql.adaptive.advisoryPartitionSizeInBytes",),
    "max_sort_partition_bytes": ("spark.sql.adaptive.advisoryPartitionSizeInBytes",),
    "max_build_hash_table_bytes": ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"),
    "default_scan_task_varchar_size": ("spark.sql.files.openCostInBytes",),
    "processing_memory": ("spark.executor.memory",),
    "pinned_memory": ("spark.memory.offHeap.size",),
}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def parse_size(text: str | int) -> int:
    """'2 GB', '2 GiB', '512mb' or a number of bytes."""
    if isinstance(text, int):
        return text
    if not (m := re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)) or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])


def settings(**options: str | int) -> dict[str, str]:
    """Spark settings for engine options such as hash_partition_bytes='512 MB'."""
    out = dict(DEFAULTS)
    for name, value in options.items():
        if name not in OPTIONS:
            raise KeyError(f"unknown option {name}")
        out |= {key: str(parse_size(value)) for key in OPTIONS[name]}
    return out


def build_session(master: str | None = None, name: str = "basalt", shuffle_partitions: int | None = None, **options: str | int) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings(**options).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
