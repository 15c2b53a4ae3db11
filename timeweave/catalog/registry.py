"""Collects query callables and, where SQL can express them, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return add


#: Rows of one task of a map stage that costs far more than a shuffle of the row.
SPREAD_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Scan of a driver table.  ``spread`` deals its rows out (:func:`dealt`), for map stages that cost far more than a
    shuffle of the row.  Rows are counted from the file footers."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df, df.count()) if spread else df


def dealt(df: DataFrame, n_rows: int) -> DataFrame:
    """``n_rows`` rows dealt out to all task slots, and to more tasks where one would get more than ``SPREAD_ROWS``."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // SPREAD_ROWS))
    return df.repartition(tasks)
