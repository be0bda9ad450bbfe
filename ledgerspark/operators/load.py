"""Load a result into a target table: conflict check, append, upsert, artifacts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.errors import GateError, PeriodConflict, ReportError
from ledgerspark.functions import values
from ledgerspark.functions.names import named
from ledgerspark.operators.reconcile import join_form, key_form
from ledgerspark.plans.rollup import PERIOD
from ledgerspark.session import settle
from ledgerspark.sources.target import period_rows

INSERT, UPDATE, NOOP = "insert", "update", "noop"
RECORD_ID = "record_id"
PROJECT = "project"


# Artifacts


def write_artifact(
    result: DataFrame, folder: str, project: str, period: str, group_fields: Sequence[str]
) -> str:
    """Write a result with its metadata; returns the artifact's path.

    An empty result keeps its columns, because the layout is part of the table schema.
    """
    made_at = datetime.now()
    spark = result.sparkSession
    name = artifact_name(period, project, made_at)
    path = f"{folder.rstrip('/')}/{name}"
    result.write.mode("errorifexists").parquet(f"{path}/result")
    metadata = spark.createDataFrame(
        [(project, period, made_at.isoformat(), json.dumps(list(group_fields)))],
        "project string, period string, generated_at string, group_fields string",
    )
    metadata.write.mode("errorifexists").parquet(f"{path}/metadata")
    return path


def read_artifact(spark: SparkSession, path: str, project: str) -> tuple[DataFrame, dict]:
    """Result and metadata of an artifact; refused when it belongs to another project."""
    metadata = spark.read.parquet(f"{path}/metadata").first().asDict()
    if metadata["project"] != project:
        raise GateError(f"the artifact belongs to project {metadata['project']}")
    metadata["group_fields"] = json.loads(metadata["group_fields"])
    return spark.read.parquet(f"{path}/result"), metadata


def artifact_name(period: str, project: str, made_at: datetime) -> str:
    safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in project)
    return f"{period}_{safe}_{made_at:%Y%m%d-%H%M%S}"


def overview(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count("*").alias("row_count"), F.lit(len(result.columns)).alias("field_count")
    )


# Outbound typing


def outbound(result: DataFrame, field_types: Mapping[str, int]) -> DataFrame:
    """Columns in the type of the target's fields; only number fields change."""
    return result.select(
        *[values.typed_for_target(named(n), field_types.get(n)).alias(n) for n in result.columns]
    )


def outbound_problems(result: DataFrame, field_types: Mapping[str, int]) -> DataFrame:
    """Values a number field of the target cannot take."""
    numbers = [name for name in result.columns if field_types.get(name) == 2]
    notes = [
        F.when(
            values.typed_for_target_invalid(named(name), 2),
            F.struct(F.lit(name).alias("field"), named(name).cast("string").alias("value")),
        )
        for name in numbers
    ]
    if not notes:
        return result.select(F.lit("").alias("field"), F.lit("").alias("value")).where("false")
    return result.select(F.explode(F.array_compact(F.array(*notes))).alias("note")).select("note.*")


# Strategies


def period_conflict(target: DataFrame, period: str) -> DataFrame:
    """One row with the number of rows the target already holds for the period."""
    existing = period_rows(target, period).agg(F.count("*").alias("existing_count"))
    return existing.select(
        F.lit(period).alias(PERIOD),
        "existing_count",
        (F.col("existing_count") > 0).alias("conflict"),
    )


def require_empty_period(target: DataFrame, period: str) -> None:
    report = period_conflict(target, period)
    found = report.first()
    if found["conflict"]:
        raise PeriodConflict("the period already has rows", report, found["existing_count"])


def append(result: DataFrame, path: str) -> None:
    result.write.mode("append").partitionBy(PERIOD).parquet(path)


def keyed(table: DataFrame, keys: Sequence[str], prefix: str = "__k") -> DataFrame:
    """Add the normalized form of the keys, so later joins compare plain texts."""
    kinds = {item.name: item.dataType for item in table.schema.fields}
    return table.withColumns(
        {f"{prefix}{i}": join_form(named(key), kinds[key]) for i, key in enumerate(keys)}
    )


def duplicate_source_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows that would hit the same target row."""
    ids = [f"__k{i}" for i in range(len(keys))]
    return (
        keyed(source, keys).groupBy(*ids).agg(F.count("*").alias("rows")).where("rows > 1")
    )


def plan_upsert(
    source: DataFrame, target: DataFrame, keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """Source rows with ``action`` and the ``record_id`` of the target row they meet.

    Rows are matched on normalized keys. The target may hold a key more than once; then the row
    with the largest record id is the one that counts. Only the source's own columns are compared;
    ``strict`` also counts a filled column that exists in the target alone.
    """
    shared = [n for n in source.columns if n in target.columns and n not in keys]
    alone = [n for n in target.columns if n not in source.columns and n != RECORD_ID]
    source_kinds = {item.name: item.dataType for item in source.schema.fields}
    target_kinds = {item.name: item.dataType for item in target.schema.fields}
    ids = [f"__k{i}" for i in range(len(keys))]
    forms = [key_form(named(n), target_kinds[n]).alias(f"f{i}") for i, n in enumerate(shared)]
    extra = F.lit(False)
    for name in alone if strict else []:
        extra = extra | key_form(named(name), target_kinds[name]).isNotNull()
    last = (
        keyed(target, keys)
        .groupBy(*[F.col(i).alias(f"__t{i}") for i in ids])
        .agg(
            F.max_by(
                F.struct(*forms, extra.alias("extra"), named(RECORD_ID).alias(RECORD_ID)),
                named(RECORD_ID),
            ).alias("__met")
        )
    )
    rows = keyed(source, keys)
    same = None
    for i in ids:
        term = rows[i] == last[f"__t{i}"]
        same = term if same is None else same & term
    differs = F.col("__met.extra")
    for i, name in enumerate(shared):
        mine = key_form(named(name), source_kinds[name])
        differs = differs | ~mine.eqNullSafe(F.col(f"__met.f{i}"))
    for name in source.columns:
        if name not in shared and name not in keys:
            differs = differs | key_form(named(name), source_kinds[name]).isNotNull()
    action = (
        F.when(F.col("__met").isNull(), F.lit(INSERT))
        .when(differs, F.lit(UPDATE))
        .otherwise(F.lit(NOOP))
    )
    return rows.join(last, same, "left").select(
        *[named(n) for n in source.columns],
        F.col(f"__met.{RECORD_ID}").alias(RECORD_ID),
        action.alias("action"),
    )


def merged_state(
    actions: DataFrame, target: DataFrame, columns: Sequence[str], new_id: Column | None = None
) -> DataFrame:
    """The target after the actions: updated rows replaced, new rows added, all others kept."""
    updates = actions.where(F.col("action") == UPDATE).select(
        F.col(RECORD_ID).alias("__id"), *[named(n).alias(f"__new_{n}") for n in columns]
    )
    hit = F.col("__id").isNotNull()
    fields = [n for n in target.columns if n != RECORD_ID]
    kinds = {item.name: item.dataType for item in target.schema.fields}

    def updated(name: str) -> Column:
        if name not in columns:
            return named(name)
        taken = named(f"__new_{name}").cast(kinds[name])
        return F.when(hit, taken).otherwise(named(name)).alias(name)

    kept = target.join(updates, target[RECORD_ID] == updates["__id"], "left").select(
        RECORD_ID, *[updated(name) for name in fields]
    )
    fresh = F.uuid() if new_id is None else new_id
    added = actions.where(F.col("action") == INSERT).select(
        fresh.cast(kinds[RECORD_ID]).alias(RECORD_ID),
        *[
            (named(n) if n in columns else F.lit(None)).cast(kinds[n]).alias(n)
            for n in fields
        ],
    )
    return kept.unionByName(added)


def upsert(
    spark: SparkSession, source: DataFrame, path: str, period: str, keys: Sequence[str]
) -> DataFrame:
    """Upsert ``source`` into one period of the table at ``path``; returns the action counts.

    The new state of the period is written as a whole and swapped in when the job commits, so a
    lost executor only repeats tasks. Rows without a source row stay. Source columns that the target
    lacks are refused by name: their values would be lost.
    """
    unknown = sorted(set(source.columns) - set(spark.read.parquet(path).columns))
    if unknown:
        raise GateError(f"the target has no columns: {', '.join(unknown)}")
    # The keys are tested and then matched; a lazy rollup would be computed for each.
    source = settle(source)
    repeated = duplicate_source_keys(source, keys)
    if not repeated.isEmpty():
        raise ReportError("several source rows share one target key", repeated)
    target = period_rows(spark.read.parquet(path), period)
    actions = settle(plan_upsert(source, target, keys))
    counts = actions.groupBy("action").agg(F.count("*").alias("rows"))
    changed = actions.where(F.col("action") != NOOP)
    if not changed.isEmpty():
        state = merged_state(actions, target, source.columns)
        (
            state.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PERIOD)
            .parquet(path)
        )
    return counts


