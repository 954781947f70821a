"""Named queries with the SQL that another database answers the same question by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import TABLES, load_tables, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_NAMES = re.compile(rf"\b({'|'.join(TABLES)})\b")


def op(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir)."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def frames(name: str, oracle: str | None = None):
    """Register a function of the DataFrames that its parameters without a default name."""

    def add(f):
        import inspect

        wanted = [n for n, p in inspect.signature(f).parameters.items() if n != "spark" and p.default is p.empty]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = {n: table(spark, sf_dir, n) for n in wanted}
            return f(spark, **given) if "spark" in inspect.signature(f).parameters else f(**given)

        op(name, oracle)(run)
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in SQL; where both dialects agree the oracle is the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load_tables(spark, sf_dir, sorted(set(_NAMES.findall(text))))
        return spark.sql(text)

    op(name, text if oracle is None else oracle)(run)
