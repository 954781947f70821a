"""SQL over a directory of tables, with options that can be set while it runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import load_tables
from .operators.scan import LEVELS, cached
from .session import OPTIONS, parse_size


class Engine:
    """Tables as views; execute() gives a DataFrame, so its result can be used in further queries."""

    def __init__(self, spark: SparkSession, directory: str, tables: list[str] | None = None):
        self.spark, self.directory, self.level = spark, directory, "none"
        self.tables = load_tables(spark, directory, tables)

    def set(self, option: str, value: str | int) -> None:
        """Set a size such as hash_partition_bytes, or scan_cache_level, which keeps tables from then on."""
        if option == "scan_cache_level":
            if value not in LEVELS:
                raise ValueError(f"scan_cache_level is one of {', '.join(LEVELS)}")
            self._keep(str(value))
            return
        if option not in OPTIONS:
            raise KeyError(f"unknown option {option}")
        for key in OPTIONS[option]:
            if not self.spark.conf.isModifiable(key):
                raise ValueError(f"{option} must be set before the session starts")
            self.spark.conf.set(key, str(parse_size(value)))

    def _keep(self, level: str) -> None:
        for name, df in self.tables.items():
            df.unpersist()
            cached(df, level).createOrReplaceTempView(name)
        self.level = level

    def close(self) -> None:
        """Keep no table's rows any longer."""
        self._keep("none")

    def execute(self, sql: str, args: dict[str, Any] | list | None = None, **frames: DataFrame) -> DataFrame:
        """A query; `:name` or `?` stand for args, `{name}` for a DataFrame."""
        return self.spark.sql(sql, args=args, **frames)

    def register(self, name: str, function: Callable, returns: str, aggregate: bool = False) -> None:
        """A function of pandas columns, for use in SQL; an aggregate one takes a group's columns and gives one value."""
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        def over_columns(*x: pd.Series) -> pd.Series:
            return function(*x)

        def over_group(*x: pd.Series) -> Any:
            return function(*x)

        over_columns.__annotations__ = {"x": pd.Series, "return": pd.Series}
        over_group.__annotations__ = {"x": pd.Series, "return": object}
        self.spark.udf.register(name, pandas_udf(over_group if aggregate else over_columns, returns))

    def explain(self, sql: str) -> str:
        return self.spark.sql(sql)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
