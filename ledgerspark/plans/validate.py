"""Checks before a rollup: sheets, ranges, fields, conditions and target columns.

Every file is checked, not only a sample; headers are small next to the rows below them. A sample
can still be taken with ``sources.files.sample_file``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.errors import ConditionError, ValidationFailed
from ledgerspark.functions import conditions
from ledgerspark.functions.values import VALIDATION_PERIOD
from ledgerspark.plans.rollup import FAILED_CONDITION, PERIOD
from ledgerspark.plans.rules import GROUP, SUM, Rule, RuleBundle, SheetSpec
from ledgerspark.schemas import CHECKS
from ledgerspark.session import lookup_side
from ledgerspark.sources.grid import (
    CSV_NEEDS_DEFAULT,
    DEFAULT_NEEDS_ONE,
    FILE_KEY,
    MISSING_SHEET,
    bind_header,
    called,
    cell_at,
    data_rows,
    matches,
    not_blank,
    pick_sheet,
    resolve_header,
    sheet_bounds,
)

# Target field types (1 text, 2 number, 3 single select) each output may have.
PERIOD_TYPES = [1, 2]
SUM_TYPES = [2]
GROUP_TYPES = [1, 3]

# Messages of the report.
SHEET_FOUND = "Sheet exists."
OPTIONAL_SHEET_MISSING = "Optional sheet is missing."
RANGE_GOOD = "The configured data range is valid."
RANGE_UNKNOWN = "The data range cannot be validated because the required sheet is missing."
FIELD_FOUND = "Field exists."
FIELD_MISSING = "Required field is missing."
OPTIONAL_FIELD_MISSING = "Optional field is missing."
FIELD_SHARED = "The field mapping is duplicated in the sampled source file."
CONDITION_GOOD = "Condition can be evaluated."
TARGET_FOUND = "Target field exists in the target table."
TARGET_MISSING = "Target field is missing in the target table."
TYPE_GOOD = "Target field type is compatible with the inferred expectation."
TYPE_BAD = "Target field type does not match the inferred expectation."


def check(name: str, scope: Column, passed: Column, message: Column, **details: Column) -> Column:
    """One report row."""
    pairs = [part for key, value in details.items() for part in (F.lit(key), value.cast("string"))]
    return F.struct(
        F.lit(name).alias("check_name"),
        scope.alias("scope"),
        passed.alias("passed"),
        message.alias("message"),
        F.create_map(*pairs).alias("details"),
    )


def sheet_checks(grid: DataFrame, spec: SheetSpec, inventory: DataFrame | None = None) -> DataFrame:
    """``sheet_exists`` and ``data_range`` of one logical sheet for every file, those without rows included."""
    bounds = sheet_bounds(grid, spec, inventory)
    scope = F.lit(f"sheet:{spec.sheet}")
    message, source = F.col("message"), F.col("source_file")
    missing = F.coalesce(message == MISSING_SHEET, F.lit(False))
    wrong_kind = F.coalesce(message.isin(CSV_NEEDS_DEFAULT, DEFAULT_NEEDS_ONE), F.lit(False))
    optional = F.lit(spec.optional)
    found_message = F.when(~missing, F.lit(SHEET_FOUND)).otherwise(
        F.lit(OPTIONAL_SHEET_MISSING if spec.optional else MISSING_SHEET)
    )
    # A range problem keeps the sheet from being opened at all, so only the range is reported.
    exists = F.when(
        missing | message.isNull(),
        check("sheet_exists", scope, ~missing | optional, found_message, source_file=source),
    )
    in_range = F.when(
        ~(missing & optional),
        check(
            "data_range",
            scope,
            message.isNull(),
            F.when(missing, F.lit(RANGE_UNKNOWN)).otherwise(
                F.coalesce(message, F.lit(RANGE_GOOD))
            ),
            source_file=source,
            resolved_last_row=F.when(~missing & ~wrong_kind, F.col("resolved_last_row")),
        ),
    )
    return bounds.select(F.explode(F.array_compact(F.array(exists, in_range))).alias("c")).select(
        "c.*"
    )


def field_checks(grid: DataFrame, spec: SheetSpec, rules: Sequence[Rule]) -> DataFrame:
    """``field_exists`` and ``condition_valid`` per file for the rules of one logical sheet.

    Header columns are matched against all rules in one aggregate over the header rows. Conditions are
    then tried on the first data row of every file, all of them in one pass; a file without data rows has
    nothing to try them on.
    """
    mine = [rule for rule in rules if rule.applies_to(spec.sheet)]
    readable = sheet_bounds(grid, spec).where(F.col("message").isNull()).select("source_file")
    header = resolve_header(pick_sheet(grid, spec), spec).join(
        readable, "source_file", "left_semi"
    )
    names: list[str] = []
    failed: dict[int, ConditionError] = {}
    for i, rule in enumerate(mine):
        if not rule.condition:
            continue
        try:
            names += [n for n in conditions.referenced_names(rule.condition) if n not in names]
        except ConditionError as error:
            failed[i] = error
    wanted = [matches(r.category, r.field) for r in mine] + [called(n) for n in names]
    bound = bind_header(header, wanted)
    offset = len(mine)
    place = {name: offset + i for i, name in enumerate(names)}
    if names:
        bound = bound.join(_sample_rows(grid, spec, bound), FILE_KEY, "left")

    reports: list[Column] = []
    for i, rule in enumerate(mine):
        reports.append(_field_report(i, rule))
        if rule.condition:
            reports.append(_condition_report(i, rule, place, failed.get(i)))
    if not reports:
        return grid.sparkSession.createDataFrame([], CHECKS)
    listed = F.array_compact(F.array(*reports))
    return bound.select(F.explode(listed).alias("c")).select("c.*")


def _field_report(i: int, rule: Rule) -> Column:
    count, optional = F.col(f"n{i}"), F.lit(rule.optional)
    message = (
        F.when(count > 1, F.lit(FIELD_SHARED))
        .when(count == 1, F.lit(FIELD_FOUND))
        .otherwise(F.lit(OPTIONAL_FIELD_MISSING if rule.optional else FIELD_MISSING))
    )
    return check(
        "field_exists",
        F.lit(f"rule:{rule.output}"),
        (count == 1) | ((count == 0) & optional),
        message,
        source_file=F.col("source_file"),
        category=F.lit(rule.category),
        field=F.lit(rule.field),
        matched_column=F.when(count == 1, F.col(f"x{i}") + 1),
    )


def _condition_report(
    i: int, rule: Rule, place: Mapping[str, int], error: ConditionError | None
) -> Column:
    scope = F.lit(f"rule:{rule.output}")
    source = F.col("source_file")
    text = F.lit(rule.condition if isinstance(rule.condition, str) else "python condition")
    if error is not None:
        report = check(
            "condition_valid",
            scope,
            F.lit(False),
            F.lit(str(error)),
            source_file=source,
            condition=text,
            code=F.lit(error.code),
        )
    else:
        unknown = F.array_compact(
            F.array(
                *[
                    F.when(F.col(f"n{place[name]}") != 1, F.lit(name))
                    for name in conditions.referenced_names(rule.condition)
                ],
                F.lit(None).cast("string"),
            )
        )
        first = F.try_element_at(unknown, F.lit(1))
        fails = _fails_on_sample(rule, place)
        report = check(
            "condition_valid",
            scope,
            first.isNull() & ~fails,
            F.when(first.isNotNull(), F.concat(F.lit("the condition names an unknown field: "), first))
            .when(fails, F.lit(FAILED_CONDITION))
            .otherwise(F.lit(CONDITION_GOOD)),
            source_file=source,
            condition=text,
            code=F.when(first.isNotNull(), F.lit(conditions.CODE_UNRESOLVED)).when(
                fails, F.lit(conditions.CODE_RUNTIME)
            ),
        )
    # A condition is only looked at where its rule has a column.
    return F.when(F.col(f"n{i}") == 1, report)


def _sample_rows(grid: DataFrame, spec: SheetSpec, bound: DataFrame) -> DataFrame:
    """The first row of every file that holds anything in a named column: ``sample``."""
    named_idx = lookup_side(bound.select(*FILE_KEY, "named_idx"))
    rows = data_rows(pick_sheet(grid, spec), spec).join(named_idx, FILE_KEY)
    filled = rows.where(not_blank(F.col("cells"), F.col("named_idx")))
    return filled.groupBy(*FILE_KEY).agg(F.min_by("cells", "row_no").alias("sample"))


def _fails_on_sample(rule: Rule, place: Mapping[str, int]) -> Column:
    """Whether the condition has no outcome on the sample row of a file."""

    def value(name: str) -> conditions.Term:
        i = place[name]
        cell = cell_at(F.when(F.col(f"n{i}") == 1, F.col(f"x{i}")), F.col("sample"), F.col("stem"))
        return conditions.Term(cell, kind=T.StringType())

    term = conditions.build(rule.condition, value, VALIDATION_PERIOD)
    if term is None or term.bad is None:
        return F.lit(False)
    # Conditions that name no field have the same outcome in every file.
    return term.bad & F.col("sample").isNotNull() if place else term.bad


def source_checks(grid: DataFrame, bundle: RuleBundle, inventory: DataFrame | None = None) -> DataFrame:
    """All checks of the files of ``grid``; with an ``inventory`` also of files that have no rows."""
    parts = []
    for spec in bundle.sheets:
        parts.append(sheet_checks(grid, spec, inventory))
        parts.append(field_checks(grid, spec, bundle.rules))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def expected_target_fields(projects: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns every project's target must have, with the field types they may have.

    The first rule of an output decides its type. Works on whole catalogs.
    """
    allowed = F.when(F.col("kind") == SUM, F.array(*[F.lit(t) for t in SUM_TYPES])).when(
        F.col("kind") == GROUP, F.array(*[F.lit(t) for t in GROUP_TYPES])
    )
    outputs = (
        rules.where(F.col("kind").isin(SUM, GROUP) & (F.col("output") != PERIOD))
        .groupBy("project", F.col("output").alias("field_name"))
        .agg(F.min_by(allowed, "rule_no").alias("allowed"))
    )
    periods = projects.select(
        "project",
        F.lit(PERIOD).alias("field_name"),
        F.array(*[F.lit(t) for t in PERIOD_TYPES]).alias("allowed"),
    )
    targets = projects.select("project", "target_table")
    return outputs.unionByName(periods).join(targets, "project")


def target_checks(expected: DataFrame, target_fields: DataFrame) -> DataFrame:
    """``target_field_exists`` and ``target_field_type`` for every expected column."""
    actual = target_fields.select("target_table", "field_name", F.col("type").alias("actual"))
    met = expected.join(actual, ["target_table", "field_name"], "left")
    scope = F.concat(F.lit("target_field:"), F.col("field_name"))
    found = F.col("actual").isNotNull()
    fits = F.array_contains("allowed", F.col("actual"))
    table = F.col("target_table")
    exists = check(
        "target_field_exists",
        scope,
        found,
        F.when(found, F.lit(TARGET_FOUND)).otherwise(F.lit(TARGET_MISSING)),
        target_table=table,
    )
    typed = F.when(
        found,
        check(
            "target_field_type",
            scope,
            fits,
            F.when(fits, F.lit(TYPE_GOOD)).otherwise(F.lit(TYPE_BAD)),
            target_table=table,
            actual_type=F.col("actual"),
            allowed_types=F.array_join("allowed", ","),
        ),
    )
    reports = F.array_compact(F.array(exists, typed))
    return met.select("project", F.explode(reports).alias("c")).select("project", "c.*")


def error_count(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(~F.col("passed")).alias("error_count"))


def require_all_passed(checks: DataFrame) -> DataFrame:
    """The report, or ``ValidationFailed`` when any check in it failed."""
    failed = error_count(checks).first()[0]
    if failed:
        raise ValidationFailed("the validation failed", checks, failed)
    return checks
