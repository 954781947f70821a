"""Aggregate functions with the host database's types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_exact(x: Column, precision: int = 18, scale: int = 2) -> Column:
    """The sum of a double column of that many places, free of the order of addition."""
    return F.sum(x.cast(f"decimal({precision},{scale})")).cast("double")


def avg_exact(x: Column, precision: int = 18, scale: int = 2) -> Column:
    """The mean of a double column of that many places: an exact sum, divided once."""
    return sum_exact(x, precision, scale) / F.count(x)


def avg_decimal(x: Column) -> Column:
    """The mean of a decimal column, as a double."""
    return F.sum(x).cast("double") / F.count(x)


def count_distinct(*columns: Column) -> Column:
    """Of several columns the tuples count, those with nulls included; of one, nulls don't."""
    return F.count_distinct(columns[0] if len(columns) == 1 else F.struct(*columns))


def string_agg(x: Column, separator: str, by: Column | None = None) -> Column:
    """The strings of a group, in order of `by` or of their own; nulls are left out."""
    pair = F.struct((x if by is None else by).alias("k"), x.alias("x"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), pair))), lambda p: p.x), separator)


def quantile(x: Column, q: float) -> Column:
    """The exact quantile, between two values by their distance."""
    return F.percentile(x, q)


def approx_count_distinct(x: Column, error: float = 0.02) -> Column:
    """Distinct values by a sketch, within some standard errors of `error`."""
    return F.approx_count_distinct(x, error)
