"""Grading of evaluation runs and batch statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.nested import token_counters
from ledgerspark.session import lookup_side, settle
from ledgerspark.sources.files import plain_path

# Output types that count as an artifact, and the words that mark a preview.
ARTIFACT_SUFFIX = r"(?i)\.(xlsx|xls|csv|json)$"
PREVIEW_WORDS = ["preview", "预览"]
PREVIEW_GRADER = "preview_file_exists"
COMPLETED, FAILED = "completed", "failed"

# Names of files that one read gets.
FILES_AT_ONCE = 10_000


def is_artifact(name: Column) -> Column:
    return name.rlike(ARTIFACT_SUFFIX)


def is_preview_named(name: Column) -> Column:
    low = F.lower(name)
    return low.contains(PREVIEW_WORDS[0]) | low.contains(PREVIEW_WORDS[1])


def pick_artifacts(files: DataFrame, key: str = "case_id", keep: Sequence[str] = ()) -> DataFrame:
    """Per case the file a grader looks at: preview-named files first, then the newest.

    ``files`` holds ``path`` and ``modificationTime``; ties go to the last path. The columns in
    ``keep`` come along inside the aggregate, so no join back to the files is needed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.struct(is_preview_named(name).alias("named"), "modificationTime", "path", *keep)
    return (
        files.where(is_artifact(name))
        .groupBy(key)
        .agg(F.max(rank).alias("best"))
        .select(key, F.col("best.path").alias("path"), *[F.col(f"best.{n}").alias(n) for n in keep])
    )


def grade_artifacts(cases: DataFrame, files: DataFrame, key: str = "case_id") -> DataFrame:
    """Score 1 for cases with an artifact, with size and SHA-256 of the file.

    ``files`` holds ``path``, ``modificationTime``, ``length`` and ``content``; a path names one file. The
    files that count are chosen by what is known about them, and only their contents are hashed, where they
    are read.
    """
    picked = settle(pick_artifacts(files.drop("content"), key, keep=["length"]))
    chosen = lookup_side(picked.select(F.col("path").alias("chosen")).distinct())
    hashed = files.join(chosen, F.col("path") == F.col("chosen"), "left_semi").select(
        F.col("path").alias("hashed"), F.sha2("content", 256).alias("sha256")
    )
    return _graded(cases, picked, hashed, key)


def grade_files(cases: DataFrame, listing: DataFrame, key: str = "case_id") -> DataFrame:
    """``grade_artifacts`` for files in a file system: no file is opened but those that count.

    ``listing`` holds ``path``, ``modificationTime`` and ``length``, as an inventory has them. Paths are
    given to the reader in parts, as any scan gets its files by name; contents stay in the tasks.
    """
    spark = listing.sparkSession
    picked = settle(pick_artifacts(listing, key, keep=["length"]))
    part: list[str] = []
    hashed = None

    def opened() -> DataFrame:
        found = spark.read.format("binaryFile").load(part).select(
            plain_path().alias("hashed"), F.sha2("content", 256).alias("sha256")
        )
        return settle(found if hashed is None else hashed.unionByName(found))

    for row in picked.select("path").distinct().toLocalIterator():
        part.append(row["path"])
        if len(part) == FILES_AT_ONCE:
            hashed = opened()
            part = []
    if part:
        hashed = opened()
    if hashed is None:
        hashed = spark.createDataFrame([], "hashed string, sha256 string")
    return _graded(cases, picked, hashed, key)


def _graded(cases: DataFrame, picked: DataFrame, hashed: DataFrame, key: str) -> DataFrame:
    best = picked.join(hashed, F.col("path") == F.col("hashed"), "left")
    return cases.join(best, key, "left").select(
        *cases.columns,
        F.lit(PREVIEW_GRADER).alias("grader"),
        F.when(F.col("path").isNotNull(), 1).otherwise(0).alias("score"),
        F.col("path").alias("file"),
        F.col("length").alias("size_bytes"),
        "sha256",
    )


def newest_changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per key the newest file that is new or newer than in the earlier listing."""
    old = before.select("path", F.col("modificationTime").alias("old_time"))
    changed = after.join(old, "path", "left").where(
        F.col("old_time").isNull() | (F.col("modificationTime") > F.col("old_time"))
    )
    return changed.groupBy(key).agg(
        F.max(F.struct("modificationTime", "path")).alias("best")
    ).select(key, F.col("best.path").alias("path"))


def verdicts(runs: DataFrame) -> DataFrame:
    """Status, score and verdict per case from ``exit_code`` and ``graders``."""
    status = F.when(F.col("exit_code") == 0, F.lit(COMPLETED)).otherwise(F.lit(FAILED))
    all_good = F.forall("graders", lambda g: F.coalesce(g["score"] == 1, F.lit(False)))
    good = (F.col("exit_code") == 0) & F.coalesce(all_good, F.lit(True))
    return runs.withColumns(
        {
            "status": status,
            "score": F.when(good, 1).otherwise(0),
            "verdict": F.when(good, F.lit("pass")).otherwise(F.lit("fail")),
        }
    )


def with_tokens(runs: DataFrame, usage: str = "usage") -> DataFrame:
    return runs.withColumns(
        {f"tokens_{name}": column for name, column in token_counters(F.col(usage)).items()}
    )


def batch_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Case counts, batch status and token totals; a total without any value is NULL."""
    tokens = [n for n in ("tokens_input", "tokens_output", "tokens_total") if n in results.columns]
    counts = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == COMPLETED).alias("completed"),
        F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("verdict") != "pass").alias("failed"),
        *[F.sum(name).alias(name) for name in tokens],
    )
    status = F.when(F.col("failed") == 0, F.lit("passed")).otherwise(F.lit("failed"))
    return counts.withColumn("batch_status", status)


def missing_evidence(results: DataFrame, labels: Mapping[str, Column]) -> DataFrame:
    """Labels of the evidence a case lacks; ``labels`` maps a label to "is missing"."""
    marks = [F.when(test, F.lit(label)) for label, test in labels.items()]
    return results.withColumn("missing", F.array_compact(F.array(*marks)))


def unknown_graders(declared: DataFrame, known: DataFrame, column: str = "grader") -> DataFrame:
    return declared.join(known.select(column).distinct(), column, "left_anti")


def selected_cases(cases: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    """Requested cases with their position; sort by ``request_no`` to keep the order asked for."""
    return wanted.join(cases, key)


def missing_cases(cases: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    return wanted.join(cases.select(key).distinct(), key, "left_anti")


def request(table: DataFrame, ids: str, key: str = "case_id") -> DataFrame:
    """One row per requested id of an array column, numbered in the order asked for."""
    return table.select(F.posexplode(ids).alias("request_no", key))
