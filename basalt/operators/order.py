"""Sorting, top-n and limits; nulls come last either way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys(order: Sequence[str]) -> list[Column]:
    """'-price' sorts downwards, 'price' upwards."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in order]


def order_by(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*keys(order))


def top_n(df: DataFrame, n: int, *order: str, offset: int = 0) -> DataFrame:
    """The n first rows after `offset`: each partition keeps n + offset, the rest isn't sorted."""
    out = df.orderBy(*keys(order)).limit(n + offset)
    return out.offset(offset) if offset else out


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Any n rows after any `offset` rows."""
    return (df.offset(offset) if offset else df).limit(n)


def limit_percent(df: DataFrame, percent: float, *order: str) -> DataFrame:
    """The first so many rows in a hundred, rounded down, of a total order."""
    n = int(df.count() * percent // 100)
    return top_n(df, n, *order)
