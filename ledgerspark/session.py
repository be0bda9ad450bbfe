"""Session settings and shared storage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.names import named

# Where the frames that ``store`` gave have their files.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

# Settings a job should run with. All are runtime settings, none replaces a cluster default that
# sizes memory or executors.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What one Arrow batch brings into a Python worker, whatever the width of its rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # Beyond this method size the JVM stops compiling; Spark then uses smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A JSON object that repeats a key is valid; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Lets the CSV reader decode GB18030 files.
    "spark.sql.legacy.javaCharsets": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ledgerspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the written rows.

    Used where a result feeds more than one later step: without it every step would scan the
    source again, and a lost executor would replay the whole lineage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For wide or large rows that later steps filter and prune; ``settle`` is for small results.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


# A lookup side is broadcast up to this size, measured on its rows.
BROADCAST_BYTES = 32 * 1024 * 1024


def lookup_side(df: DataFrame) -> DataFrame:
    """The small side of a join, written once and measured: broadcast if it is small enough.

    Otherwise it stays a plain side, and the join shuffles both sides on their keys.
    """
    settled = settle(df)
    text = F.to_json(F.struct(*[named(name) for name in settled.columns]))
    size = settled.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return F.broadcast(settled) if size <= BROADCAST_BYTES else settled


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name for a table that a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(stored: DataFrame) -> None:
    """Delete a table that ``store`` wrote, once its successor is written.

    The frame, and all that reads it, ends here. A frame that ``store`` did not give stays as it is.
    """
    place = _STORED.pop(stored, None)
    if place is None:
        return
    context = stored.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for jobs that run inside; afterwards all are as before."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def batches_of(spark: SparkSession, rows: int):
    """Bound the rows of an Arrow batch for jobs that run inside."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})
