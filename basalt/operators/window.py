"""Running sums and ranks for keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch
from .order import keys

_ROWS = 1 << 17  # of a range


def _by_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """df dealt by ranges of key and order, with the range's number; the rows of a range and key are in one task.

    Tasks are as many as ranges: as their number is given, adaptive execution doesn't put them together.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    tasks = max(-(-(df.count() if rows is None else rows) // _ROWS), 1)
    dealt = df.repartitionByRange(tasks, *[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)  # once, as whoever reads the rows must agree on the ranges
    return spark.read.schema(dealt.schema).parquet(path).repartition(tasks, "__range", *by)


def _carry(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with what is carried from earlier ranges of their key: of a range only the first key has any, so there is a row a range at most."""
    named = carried.withColumnRenamed("__range", "__r").withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.col("__range") == F.col("__r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(named), on, "left")


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], ties: Sequence[str] = (), rank: str = "rank", dense: str = "dense", number: str = "number", rows: int | None = None) -> DataFrame:
    """df with each row's rank and dense rank in its key by `order`, and its number by `order` and then `ties`; nulls come last.

    Rows are dealt by ranges as in `running_sum`, by `ties` too, so rows of equal order may be spread over ranges; each range is
    ranked on its own, and what stands before it in its key is carried from one row for each range and key.  `rows` is df's number of rows.
    """
    dealt = _by_ranges(df, by, [F.col(c) if isinstance(c, str) else c for c in (*keys(order), *keys(ties))], rows)
    inside, places = Window.partitionBy("__range", *by).orderBy(*keys(order)), Window.partitionBy("__range", *by).orderBy(*keys(order), *keys(ties))
    local = dealt.withColumns({"__rank": F.rank().over(inside), "__dense": F.dense_rank().over(inside), "__number": F.row_number().over(places)})
    value = F.struct(*[F.col(k.removeprefix("-")) for k in order])
    ends = local.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.max("__dense").alias("__d"), F.max("__rank").alias("__last_rank"), F.min_by(value, "__rank").alias("__first"), F.max_by(value, "__rank").alias("__last"))
    ranges = Window.partitionBy(*by).orderBy("__range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.col("__first").eqNullSafe(F.lag("__last").over(ranges)) & F.lag("__n").over(ranges).isNotNull(), F.lit(False))
    before = ends.withColumn("__goes_on", goes_on).withColumn("__before", F.sum("__n").over(earlier))
    before = before.withColumn("__start", F.when((F.col("__d") > 1) | ~F.col("__goes_on"), F.coalesce("__before", F.lit(0)) + F.col("__last_rank")))  # of the last row's peers, if it is in this range
    before = before.withColumn("__started", F.last("__start", ignorenulls=True).over(earlier)).withColumn("__values", F.sum(F.col("__d") - F.col("__goes_on").cast("int")).over(earlier))
    carried = before.where("__before IS NOT NULL").select("__range", *by, "__before", "__goes_on", "__started", "__values")
    joined = _carry(local, carried, by)
    n, goes_on = F.coalesce("__before", F.lit(0).cast("long")), F.coalesce("__goes_on", F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(goes_on & (F.col("__rank") == 1), F.col("__started")).otherwise(n + F.col("__rank")).alias(rank),
        (F.coalesce("__values", F.lit(0).cast("long")) + F.col("__dense") - goes_on.cast("int")).alias(dense),
        (n + F.col("__number")).alias(number),
    )


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """df with the sum of `value` over its key's rows up to each, in a total order.

    Rows are dealt by ranges of key and order, so a key of any size is spread over tasks; each range is summed on its own, and the totals of
    a key's earlier ranges, one row a range, are carried into the later ones.  Null keys are a key.
    """
    rows = _by_ranges(df, by, [F.col(c) for c in order])
    inside = F.sum(value).over(Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__range", *by).agg(F.sum(value).alias("__total"))
    carried = totals.select("__range", *by, F.sum("__total").over(before).alias("__carried")).where("__carried IS NOT NULL")
    joined = _carry(rows.withColumn("__inside", inside), carried, by)
    total = F.when(F.col("__inside").isNull(), F.col("__carried")).otherwise(F.col("__inside") + F.coalesce("__carried", F.lit(0)))
    return joined.select(*df.columns, total.alias(name))
