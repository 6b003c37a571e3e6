"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        """The table as its files are split, unless the session sets ``docweave.partitions``.

        The setting is for local runs on tables of one small file and row group, which would keep one core busy.
        """
        df, parts = read(self.spark, self.sf_dir, table), self.spark.conf.get("docweave.partitions", None)
        return df.repartition(int(parts)) if parts else df

    def spread(self, table: str) -> DataFrame:
        """The table dealt to all tasks by a hash of its rows: for work on a row that takes far longer than moving it.

        Files are split between row groups only, so a table of a million rows may otherwise be one task.
        """
        df = self.__getattr__(table)
        return df.repartition(*df.columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the DuckDB counterpart."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
