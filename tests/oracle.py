"""Run registered queries next to their SQL checks: ``python tests/oracle.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    link = duckdb.connect()
    for name in TABLES:
        link.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return link


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value


def ordered(columns: list[str], rows: list) -> list[tuple]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


def differences(spark, sf_dir: str, name: str, link=None) -> str | None:
    """None if both sides agree, else a short text. Queries without SQL only have to run."""
    from ledgerspark.registry import ORACLE, QUERIES

    frame = QUERIES[name](spark, sf_dir)
    mine = ordered(frame.columns, [tuple(row) for row in frame.collect()])
    if name not in ORACLE:
        return None if mine else "no rows"
    link = link or connect(sf_dir)
    cursor = link.execute(ORACLE[name])
    columns = [item[0] for item in cursor.description]
    other = ordered(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    if mine != other:
        mine_set, other_set = set(mine), set(other)
        left = [row for row in mine if row not in other_set][:3]
        right = [row for row in other if row not in mine_set][:3]
        return f"rows {len(mine)} / {len(other)}\n   spark {left}\n   sql   {right}"
    if not mine:
        return "no rows on either side"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from ledgerspark.registry import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    link = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            found = differences(spark, sf_dir, name, link)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'ok ' if found is None else 'BAD'} {kind:4} {time.time() - started:6.2f}s {name}")
        if found:
            print("   " + found)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
