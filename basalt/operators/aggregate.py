"""Grouping for keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Null keys are a group; without keys one row comes back."""
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def distinct_keys(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by).distinct()


def count_distinct_by(df: DataFrame, by: Sequence[str], what: Sequence[str], name: str) -> DataFrame:
    """Distinct tuples in each group: tuples are told apart first, so a large group isn't gathered in one task.

    Null keys are a group.  Of several columns the tuples count, those with nulls included; of one, nulls don't.
    """
    tuples = df.select(*by, *[F.col(c).alias(f"__{k}") for k, c in enumerate(what)]).distinct()
    return tuples.groupBy(*by).agg(F.count("__0" if len(what) == 1 else "*").alias(name))


def dealt(df: DataFrame, by: Sequence[str], rows: int = 1 << 18) -> DataFrame:
    """df's rows dealt by keys to tasks of about so many: as their number is given, adaptive execution doesn't put them together.

    Rows of numbers that follow each other take a few bytes once compressed, and by these bytes it would let a task have many millions.
    """
    return df.repartition(max(-(-df.count() // rows), 1), *by)


def counted(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The rows of each key."""
    return dealt(df.select(*by), by).groupBy(*by).agg(F.count("*").alias(name))
