"""Scans of a target or baseline table for one period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions import nested
from ledgerspark.functions.names import named
from ledgerspark.plans.rollup import PERIOD


def period_literal(table: DataFrame, period: str | int) -> Column:
    """The period in the type of the table's own column, so the filter reaches the scan."""
    text = str(period).strip()
    kind = table.schema[PERIOD].dataType
    if isinstance(kind, T.NumericType) and text.isdigit():
        return F.lit(int(text)).cast(kind)
    return F.lit(text)


def period_rows(table: DataFrame, period: str | int) -> DataFrame:
    return table.where(F.col(PERIOD) == period_literal(table, period))


def baseline_rows(table: DataFrame, period: str | int, fields: Sequence[str]) -> DataFrame:
    """Chosen columns of one period; the period column always comes along."""
    text = str(period).strip()
    if len(text) != 6 or not text.isdigit():
        raise ValueError("the baseline period must be a six-digit YYYYMM text")
    wanted = [PERIOD, *[name for name in fields if name != PERIOD]]
    return period_rows(table, text).select(*[named(name) for name in wanted])


def flatten(table: DataFrame, wrapped: Sequence[str]) -> DataFrame:
    """Replace wrapped JSON values of the named columns by their scalar text."""
    return table.withColumns({name: nested.unwrap(named(name)) for name in wrapped})
