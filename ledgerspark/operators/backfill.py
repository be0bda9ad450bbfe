"""Fill missing group keys from unique candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.names import named
from ledgerspark.session import settle


def fill_unique(groups: DataFrame, fields: Sequence[str], settled: bool = False) -> DataFrame:
    """Fill NULLs of the group ``fields`` of aggregated rows, one field after the other.

    Fields are text, and empty text does not occur (the rollup turns it into NULL). A NULL is
    filled when the rows that agree on all other group fields hold exactly one value of the field;
    later fields see earlier fills. Candidates are found by a min/max aggregate, which combines on
    the map side, and only rows with a gap are joined to them. ``groups`` holds one row per key, so
    a candidate key meets few gap rows however many rows share it. ``settled`` says that ``groups``
    has been written already.
    """
    current = groups if settled else settle(groups)
    gaps = current.agg(*[F.count_if(named(f).isNull()).alias(f) for f in fields]).first()
    for field in fields:
        if gaps[field] == 0:
            continue
        others = [name for name in fields if name != field]
        filled = _fill_alone(current, field) if not others else _fill_one(current, field, others)
        current = settle(filled)
    return current


def _fill_alone(current: DataFrame, field: str) -> DataFrame:
    column = named(field)
    low, high = current.agg(F.min(column), F.max(column)).first()
    if low is None or low != high:
        return current
    return current.withColumn(field, F.coalesce(column, F.lit(low)))


def _fill_one(current: DataFrame, field: str, others: list[str]) -> DataFrame:
    column = named(field)
    keys = {name: f"__key_{i}" for i, name in enumerate(others)}
    candidates = (
        current.groupBy(*[_key(name).alias(key) for name, key in keys.items()])
        .agg(
            F.min(column).alias("__low"),
            F.max(column).alias("__high"),
            F.count_if(column.isNull()).alias("__gaps"),
        )
        .where("__gaps > 0 and __low = __high")
        .drop("__high", "__gaps")
    )
    gaps = current.where(column.isNull())
    repaired = (
        gaps.withColumns({key: _key(name) for name, key in keys.items()})
        .join(candidates, list(keys.values()), "left")
        .withColumn(field, F.col("__low"))
        .select(*[named(name) for name in current.columns])
    )
    return current.where(column.isNotNull()).unionByName(repaired)


def _key(name: str) -> Column:
    """Key that is never NULL, so the join can use the partitioning of the aggregate."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def merge_groups(groups: DataFrame, fields: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up rows that share a key, as they may after a fill."""
    totals = [F.sum(named(name)).alias(name) for name in sums]
    return groups.groupBy(*[named(name) for name in fields]).agg(*totals)
