"""A target table whose periods are swapped as a whole.

A period's rows are written to a folder of their own. What counts is the newest pointer of a period: a row
that names its folder. A pointer is one small file that the commit of a job puts in place, so readers see
the rows before or the rows after, and a load that fails leaves what was there. Older states stay readable by
their number until ``forget`` deletes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.errors import GateError, ReportError
from ledgerspark.operators.load import NOOP, duplicate_source_keys, merged_state, plan_upsert
from ledgerspark.plans.rollup import PERIOD
from ledgerspark.session import settle

POINTERS = f"{PERIOD} string, number long, folder string"


@dataclass(frozen=True)
class VersionedTable:
    """The table below ``path``. All periods have the columns of ``schema``, the period among them as text."""

    spark: SparkSession
    path: str
    schema: str

    def pointers(self) -> DataFrame:
        """``period, number, folder``: every state that a period has had."""
        folder = f"{self.path}/pointers"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], POINTERS)
        return self.spark.read.schema(POINTERS).parquet(folder)

    def current(self) -> DataFrame:
        """The pointer that counts for each period; of two of one number the larger folder name."""
        newest = F.max(F.struct("number", "folder")).alias("newest")
        return self.pointers().groupBy(PERIOD).agg(newest).select(PERIOD, "newest.number", "newest.folder")

    def read(self, period: str | None = None, number: int | None = None) -> DataFrame:
        """The rows that count: of all periods, of one, or of an earlier state of one."""
        chosen = self.current() if number is None else self.pointers().where(F.col("number") == number)
        if period is not None:
            chosen = chosen.where(F.col(PERIOD) == period)
        # One row per period.
        folders = sorted(row["folder"] for row in chosen.select("folder").collect())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def stage(self, state: DataFrame, period: str) -> str:
        """Write a state of a period, which no reader sees yet; returns its folder."""
        folder = f"states/{period}-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        state.select(*names).write.parquet(f"{self.path}/{folder}")
        return folder

    def switch(self, period: str, folder: str) -> int:
        """Make a staged state the one that counts; returns its number."""
        last = self.pointers().where(F.col(PERIOD) == period).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(period, last + 1, folder)], POINTERS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")
        return last + 1

    def replace(self, state: DataFrame, period: str) -> int:
        return self.switch(period, self.stage(state, period))

    def upsert(self, source: DataFrame, period: str, keys: Sequence[str], new_id=None) -> DataFrame:
        """Upsert ``source`` into a period; returns the action counts. Without changes nothing is written."""
        target = self.read(period)
        unknown = sorted(set(source.columns) - set(target.columns))
        if unknown:
            raise GateError(f"the target has no columns: {', '.join(unknown)}")
        source = settle(source)
        repeated = duplicate_source_keys(source, keys)
        if not repeated.isEmpty():
            raise ReportError("several source rows share one target key", repeated)
        actions = settle(plan_upsert(source, target, keys))
        if not actions.where(F.col("action") != NOOP).isEmpty():
            self.replace(merged_state(actions, target, source.columns, new_id), period)
        return actions.groupBy("action").agg(F.count("*").alias("rows"))

    def forget(self, period: str, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` states of a period; their pointers name nothing any more."""
        old = self.pointers().where(F.col(PERIOD) == period).orderBy(F.col("number").desc(), F.col("folder").desc())
        context = self.spark.sparkContext
        for row in old.collect()[keep:]:
            at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{row['folder']}")
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
