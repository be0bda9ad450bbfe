"""How the registered queries are kept: a name, a callable and, where it exists, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` is the check over the same tables."""

    def keep(make: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return make(spark, sf_dir)

        run.__name__ = make.__name__
        run.__doc__ = make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLE[make.__name__] = sql
        return make

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money_text(column: str) -> Column:
    """Amount as a bill file would show it: two decimals."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def as_double(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.col(name).cast("double") for name in names})
