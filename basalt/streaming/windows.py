"""Windows over event time; each takes a batch or a streaming DataFrame.

On a stream the watermark bounds the state: rows later than it are left out, and windows older than it are
closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    out = df.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if out.isStreaming else out


def tumbling(df: DataFrame, time: str, size: str, by: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _windowed(_timed(df, time, late), F.window(time, size), by, aggregates)


def sliding(df: DataFrame, time: str, size: str, step: str, by: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _windowed(_timed(df, time, late), F.window(time, size, step), by, aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _windowed(_timed(df, time, late), F.session_window(time, gap), by, aggregates)


def _windowed(df: DataFrame, window: Column, by: list[str], aggregates) -> DataFrame:
    out = df.groupBy(window.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[c for c in out.columns if c != "w"])


def deduplicate(df: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; on a stream keys are forgotten once the watermark has passed."""
    timed = _timed(df, time, late)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if timed.isStreaming else timed.dropDuplicates(list(keys))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write all that is there now, and stop; a later call goes on from the checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
