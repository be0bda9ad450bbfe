"""Bill files: inventory, encodings and the CSV scan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.errors import SourceError
from ledgerspark.plans.rules import DEFAULT_SHEET
from ledgerspark.session import lookup_side, scratch_path
from ledgerspark.sources import records
from ledgerspark.sources.records import GB18030, UTF8  # noqa: F401

# File types that are read, the prefix of temporary files.
SUFFIXES = [".csv", ".xlsx", ".xlsm"]
TEMPORARY_PREFIX = "~$"
# Names that Spark's readers leave out.
HIDDEN = r"(^|/)(\.|_[^/=]*(/|$))"


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Supported files below ``path``, empty and hidden ones included: ``path, length, modificationTime, suffix``.

    Only file metadata is read, from the file system itself: Spark's own listing leaves out names that
    begin with ``_`` or ``.``.
    """
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(context._jsc.hadoopConfiguration())
    rows = []
    if system.exists(at):
        # As in any Spark scan the names are driver-side; contents never are.
        found = system.listFiles(at, True)
        while found.hasNext():
            one = found.next()
            when = datetime.fromtimestamp(one.getModificationTime() / 1000, UTC).replace(tzinfo=None)
            rows.append((_three_slashes(one.getPath().toString()), one.getLen(), when))
    return supported_files(spark.createDataFrame(rows, "path string, length long, modificationTime timestamp_ntz"))


def _three_slashes(path: str) -> str:
    """A local path as Spark spells it in the metadata of rows."""
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


def visible_copies(spark: SparkSession, hidden: list[str]) -> tuple[str | None, list[tuple[str, str]]]:
    """A folder with copies of hidden files under plain names, and ``(copy, original)`` of each.

    Such files are rare and Spark cannot be told to open them, so they are copied as a stream.
    """
    if not hidden:
        return None, []
    context = spark.sparkContext
    conf, fs = context._jsc.hadoopConfiguration(), context._jvm.org.apache.hadoop.fs
    folder = scratch_path(spark, "visible")
    pairs = []
    for i, original in enumerate(hidden):
        source, target = fs.Path(original), fs.Path(f"{folder}/{i}.csv")
        fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        pairs.append((_three_slashes(target.getFileSystem(conf).makeQualified(target).toString()), original))
    return folder, pairs


def supported_files(listed: DataFrame, path: str = "path") -> DataFrame:
    """Keep readable types and drop temporary files of office programs."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kept = suffix.isin(SUFFIXES) & ~name.startswith(TEMPORARY_PREFIX)
    return listed.withColumn("suffix", suffix).where(kept)


def require_one_type(inventory: DataFrame, path: str = "") -> str:
    """The suffix all files share; anything else is refused."""
    found = sorted(row[0] for row in inventory.select("suffix").distinct().take(len(SUFFIXES)))
    if not found:
        raise SourceError(f"no supported source files were found: {path}")
    if len(found) > 1:
        raise SourceError(f"the source holds mixed file types: {', '.join(found)}")
    return found[0]


def sample_file(inventory: DataFrame, seed: str, path: str = "path") -> DataFrame:
    """One representative file; the same seed picks the same file."""
    mixed = F.sha2(F.concat(F.lit(seed), F.col(path)).cast("binary"), 256)
    return inventory.agg(F.min_by(F.col(path), mixed).alias(path))


def plain_path(path: str = "_metadata.file_path") -> Column:
    """Path of the file a row comes from, as it is spelled on disk; Spark's own is URI-escaped."""
    spelled = F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))
    # Local paths come with one slash or three.
    return F.regexp_replace(spelled, "^file:/(?!/)", "file:///")


def csv_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Lines of all CSV files below ``path``, hidden ones included, and what tells their files' names."""
    inventory = file_inventory(spark, path)
    require_one_type(inventory, path)
    csv = inventory.where(F.col("suffix") == ".csv")
    if csv.isEmpty():
        raise SourceError(f"no CSV files were found: {path}")
    # Names below the path decide; above it Spark follows any name.
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    below = F.when(F.col("path").endswith(root), F.element_at(F.split("path", "/"), -1)).otherwise(
        F.split_part("path", F.lit(root + "/"), F.lit(-1))
    )
    hidden = [r[0] for r in csv.where(below.rlike(HIDDEN)).select("path").toLocalIterator()]
    folder, copies = visible_copies(spark, hidden)
    # No character of the prefix is ever escaped.
    name = F.substring_index("source_file", "/", -1)
    lines = records.raw_lines(spark, [path]).where(~name.startswith(TEMPORARY_PREFIX))
    if folder is None:
        return lines, lambda rows: rows.withColumn("path", plain_path("source_file"))
    originals = F.broadcast(spark.createDataFrame(copies, "copy string, original string"))

    def called(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("plain", plain_path("source_file")).join(originals, F.col("plain") == F.col("copy"), "left")
        return met.withColumn("path", F.coalesce("original", "plain"))

    return lines.unionByName(records.raw_lines(spark, [folder])), called


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``path, encoding``: judged on a file's raw lines, UTF-8 if every line is, else GB18030."""
    return records.block_facts(*csv_lines(spark, path)).select("path", "encoding").distinct()


def read_grid(spark: SparkSession, path: str, numbered: bool = True, encoding: str | None = None) -> DataFrame:
    """CSV files below ``path`` as a grid; a row has as many cells as its record.

    Files are cut into blocks however they are quoted. A file that fits no encoding stops the read by
    name; nothing is dropped without a word. Rows whose cells are all white space are dropped before rows
    are numbered. Line breaks in quotes stay as they are. ``numbered=False`` skips the numbering (``row_no``
    is NULL). Without ``encoding`` every file is judged by its own bytes. Files are read twice, once for
    quotes and encoding and once for the records.
    """
    lines, called = csv_lines(spark, path)
    found = records.csv_records(lines, records.block_facts(lines, called, encoding))
    if not numbered:
        return found.select(*_key(), F.lit(None).cast("bigint").alias("row_no"), "cells")
    return number_rows(found)


def number_rows(found: DataFrame) -> DataFrame:
    """Row numbers per file without sorting a file in one task.

    Records of a block are numbered where they are read; a record that reaches into later blocks is the
    last of its own. Blocks are put in order by a window over one row per block.
    """
    sizes = found.groupBy("source_file", "block").agg(
        F.count_if(F.col("place") < records.LAST).alias("whole"), F.count("*").alias("size")
    )
    order = F.expr(
        "coalesce(sum(size) over (partition by source_file order by block"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    offsets = lookup_side(sizes.select("source_file", "block", "whole", order.alias("before")))
    cut = F.col("place") - records.LAST
    row_no = F.col("before") + F.when(cut < 0, F.col("place")).otherwise(F.col("whole") + cut) + 1
    return found.join(offsets, ["source_file", "block"]).select(*_key(), row_no.alias("row_no"), "cells")


def _key() -> list[Column]:
    return [F.col("source_file"), F.lit(DEFAULT_SHEET).alias("sheet")]
