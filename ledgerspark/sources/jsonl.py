"""JSON lines: good objects on one side, problems with their line on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.values import strip
from ledgerspark.session import lookup_side, store
from ledgerspark.sources.files import plain_path

# Reasons a line is reported.
NOT_AN_OBJECT = "not a JSON object"
NOT_JSON = "not valid JSON"

BYTE_ORDER_MARK = "\ufeff"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Session logs below ``path`` as lines with their number: ``session_file, line_no, raw``.

    Blank lines are numbered too. File names are as they are spelled on disk.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    placed = text.select(
        plain_path().alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw"),
    )
    return number_lines(store(placed, "lines")).select(F.col("source_file").alias("session_file"), "line_no", "raw")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``line_no``. Ids of a file block follow each other, so its lines are numbered without a sort."""
    blocks = lines.groupBy("source_file", "block").agg(F.min("seq").alias("start"), F.count("*").alias("size"))
    order = F.expr(
        "coalesce(sum(size) over (partition by source_file order by block"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    offsets = lookup_side(blocks.select("source_file", "block", "start", order.alias("before")))
    line_no = F.col("seq") - F.col("start") + F.col("before") + 1
    return lines.join(offsets, ["source_file", "block"]).withColumn("line_no", line_no)


def bare_line(raw: Column) -> Column:
    return strip(F.ltrim(raw, F.lit(BYTE_ORDER_MARK)))


def line_problem(raw: Column) -> Column:
    """Why a line is no event, NULL for a good line. Blank lines are neither."""
    bare = bare_line(raw)
    parsed = F.try_parse_json(bare)
    return (
        F.when(bare == "", F.lit(None).cast("string"))
        .when(parsed.isNull(), F.lit(NOT_JSON))
        .when(~bare.startswith("{"), F.lit(NOT_AN_OBJECT))
    )


def good_lines(lines: DataFrame) -> DataFrame:
    return lines.where((bare_line(F.col("raw")) != "") & line_problem(F.col("raw")).isNull())


def problem_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("problem", line_problem(F.col("raw"))).where("problem is not null")
