"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.names import named
from ledgerspark.session import lookup_side

# A word of every contract: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_or_empty(column: str) -> Column:
    """The text, NULL counting as empty."""
    return F.coalesce(named(column), F.lit(""))


def text_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def only_staying(docs: DataFrame, decisions: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` that ``decisions(doc_id, text_key, stays)`` let stay, columns unchanged.

    Rows of one id and text are one document more than once; where any of them stays, one does.
    Only what goes is looked up, so where little goes no text is shuffled.
    """
    grouped = decisions.groupBy("doc_id", "text_key").agg(
        F.max("stays").alias("_any"), F.count(F.lit(1)).alias("_times")
    )
    special = lookup_side(
        grouped.where(~F.col("_any") | (F.col("_times") > 1)).select(
            F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "_any"
        )
    )
    # The row travels as one struct, so that no column of it can meet a name used here.
    rows = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"), named(doc_id).alias("own_id"), text_key(text).alias("own_key")
    )
    joined = rows.join(special, (F.col("own_key") == F.col("_text_key")) & F.col("own_id").eqNullSafe(F.col("_doc_id")), "left")
    plain = joined.where(F.col("_any").isNull()).select("row.*")
    if special.where("_any").isEmpty():
        return plain
    once = joined.where("_any").dropDuplicates(["own_id", "own_key"]).select("row.*")
    return plain.unionByName(once)


def over_texts(
    docs: DataFrame,
    doc_id: str,
    text: str,
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    schema: str,
) -> DataFrame:
    """``doc_id, text_key`` and what a function of whole texts adds, one row per document.

    ``text_key`` is a hash of the text; with the id it names a row, equal rows aside.

    ``make`` runs once per task and returns a function from the UTF-8 bytes of a batch's texts to
    the added columns, so that tables and caches are built once and end with the task.
    """
    rows = docs.select(
        named(doc_id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", *[part.split()[0] for part in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = make()
        for whole in batches:
            for batch in slices(whole, 2):
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added(texts)], names=names)
        del added
        give_back()

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, {schema}")


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """A value of bounded size for the executors: returns the function that they get it by.

    It travels whole, classes included, so executors need not have this package installed.
    """
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(box.value)


def give_back() -> None:
    """Return what a task used to the system: workers stay for later tasks, which need the room.

    To be called at the end of a pass that held much; it changes no result.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Bytes of text that a function looks at together; a longer text is looked at alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts take about ``most`` bytes, whatever the session's batch size."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
