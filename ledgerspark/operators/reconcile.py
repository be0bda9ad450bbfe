"""Compare a rollup with a baseline on normalized keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.names import named
from ledgerspark.functions.values import (
    WIDE_NUMBER,
    canon_key,
    canon_scalar,
    plain_number_text,
)

# Issue types, verdicts and the stand-in field of a missing record.
MISSING_IN_PREVIEW = "missing_in_preview"
MISSING_IN_BASELINE = "missing_in_baseline"
VALUE_MISMATCH = "value_mismatch"
MATCHED, MIXED = "matched", "mixed"
WHOLE_RECORD = "__record__"

# Stands for a missing key. No key form is empty, blank keys are NULL before.
NO_KEY = ""

# Next actions and the text for the business owner.
PROCEED, REPORT = "proceed", "report_to_business_owner"
CONFIRMATION = (
    "Preview 与 baseline 存在差异，recog_id=%s，period=%s，diff_type=%s，difference_count=%d。"
    "请先向业务负责人汇报差异和判断建议，确认口径后再继续迭代。"
)


@dataclass(frozen=True)
class Comparison:
    """Both sides joined on their keys: one row per key, with the fields that differ."""

    joined: DataFrame
    keys: tuple[str, ...]

    def differences(self, ordered: bool = False) -> DataFrame:
        """One row per key and differing field; a missing record counts as one row.

        ``ordered`` sorts the report by key, then field.
        """
        keys = [named(key) for key in self.keys]
        found = self.joined.where("issue_type is not null")
        items = found.select(*keys, "key_text", "issue_type", F.explode("found").alias("item"))
        listed = items.select(*keys, "key_text", "issue_type", "item.*")
        return listed.orderBy("key_text", "issue_type", "field") if ordered else listed

    def summary(self) -> DataFrame:
        """One row: record counts, matched, kind of difference, next action."""
        kinds = F.collect_set("issue_type")
        totals = self.joined.agg(
            F.coalesce(F.sum("preview_n"), F.lit(0)).alias("preview_count"),
            F.coalesce(F.sum("baseline_n"), F.lit(0)).alias("baseline_count"),
            F.count("issue_type").alias("difference_count"),
            kinds.alias("kinds"),
        )
        matched = F.col("difference_count") == 0
        return totals.select(
            matched.alias("matched"),
            "preview_count",
            "baseline_count",
            "difference_count",
            F.lit(",".join(self.keys)).alias("key_fields"),
            difference_kind(F.col("kinds")).alias("diff_type"),
            (~matched).alias("needs_confirmation"),
            F.when(matched, F.lit(PROCEED)).otherwise(F.lit(REPORT)).alias("next_action"),
        )

    def duplicate_keys(self) -> DataFrame:
        """Keys that stand for several records on one side; the last record was compared."""
        several = (F.col("preview_n") > 1) | (F.col("baseline_n") > 1)
        return self.joined.where(several).select(
            *[named(key) for key in self.keys], "preview_n", "baseline_n"
        )


def difference_kind(kinds: Column) -> Column:
    return (
        F.when(F.size(kinds) == 0, F.lit(MATCHED))
        .when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .otherwise(F.lit(MIXED))
    )


def confirmation_message(summary: DataFrame, project: str, period: str) -> DataFrame:
    """Text for the business owner; no row where both sides match."""
    text = F.format_string(
        CONFIRMATION, F.lit(project), F.lit(period), F.col("diff_type"), F.col("difference_count")
    )
    return summary.where(~F.col("matched")).select(text.alias("message"))


def compare(
    preview: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str],
    ignore: Sequence[str] = (),
    digits: int = 2,
    order: str | None = None,
) -> Comparison:
    """Join two tables on normalized keys and compare the union of their other fields.

    Where several records share a key the last one by ``order`` counts; without ``order`` the
    largest one does, so the outcome never depends on row order. Each side is reduced to one row
    per key before the join, which then needs no further shuffle and cannot skew.
    """
    left = set(preview.columns)
    right = set(baseline.columns)
    skipped = {*keys, *ignore, *([order] if order else [])}
    fields = sorted((left | right) - skipped)
    a = _one_per_key(preview, keys, fields, digits, order, "preview")
    b = _one_per_key(baseline, keys, fields, digits, order, "baseline")
    both = a.join(b, _same_keys(a, b, len(keys)), "full")

    key_columns = [
        F.nullif(F.coalesce(f"preview_k{i}", f"baseline_k{i}"), F.lit(NO_KEY)).alias(key)
        for i, key in enumerate(keys)
    ]
    no_preview, no_baseline = F.col("preview_n").isNull(), F.col("baseline_n").isNull()
    if fields:
        pairs = F.array(*[_pair(name, i) for i, name in enumerate(fields)])
        mismatches = F.filter(
            pairs, lambda item: ~item["preview_value"].eqNullSafe(item["baseline_value"])
        )
    else:
        mismatches = F.array().cast(_PAIRS)
    record = F.array(
        F.struct(
            F.lit(WHOLE_RECORD).alias("field"),
            F.when(no_baseline, _as_json("preview", fields)).alias("preview_value"),
            F.when(no_preview, _as_json("baseline", fields)).alias("baseline_value"),
        )
    )
    missing = no_preview | no_baseline
    found = F.when(missing, record).otherwise(mismatches)
    joined = both.select(
        *key_columns,
        "preview_n",
        "baseline_n",
        found.alias("found"),
        no_preview.alias("no_preview"),
        no_baseline.alias("no_baseline"),
    )
    issue = (
        F.when(F.col("no_preview"), F.lit(MISSING_IN_PREVIEW))
        .when(F.col("no_baseline"), F.lit(MISSING_IN_BASELINE))
        .when(F.size("found") > 0, F.lit(VALUE_MISMATCH))
    )
    shown = [F.coalesce(named(key), F.lit("")) for key in keys]
    joined = joined.select(
        *[named(key) for key in keys],
        F.concat_ws("|", *shown).alias("key_text"),
        "preview_n",
        "baseline_n",
        issue.alias("issue_type"),
        "found",
    )
    return Comparison(joined=joined, keys=tuple(keys))


_PAIRS = "array<struct<field:string,preview_value:string,baseline_value:string>>"


def _as_json(side: str, fields: Sequence[str]) -> Column:
    return F.to_json(
        F.struct(*[F.col(f"{side}_r")[f"f{i}"].alias(name) for i, name in enumerate(fields)])
    ) if fields else F.lit("{}")


def _pair(name: str, i: int) -> Column:
    return F.struct(
        F.lit(name).alias("field"),
        F.col("preview_r")[f"f{i}"].alias("preview_value"),
        F.col("baseline_r")[f"f{i}"].alias("baseline_value"),
    )


def _one_per_key(
    table: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    digits: int,
    order: str | None,
    side: str,
) -> DataFrame:
    kinds = {item.name: item.dataType for item in table.schema.fields}
    nothing = F.lit(None).cast("string")
    record = F.struct(
        *[
            (scalar_form(named(f), kinds[f], digits) if f in kinds else nothing).alias(f"f{i}")
            for i, f in enumerate(fields)
        ],
        F.lit(True).alias("seen"),
    )
    key_columns = [
        (join_form(named(key), kinds[key]) if key in kinds else F.lit(NO_KEY)).alias(f"{side}_k{i}")
        for i, key in enumerate(keys)
    ]
    # A record without an order value ranks below all others and never vanishes; ties are settled by
    # the records themselves, so both sides settle them alike.
    rank = F.struct(named(order).isNotNull(), named(order), F.col("record")) if order else F.col("record")
    columns = [*key_columns, record.alias("record")] + ([named(order)] if order else [])
    return (
        table.select(*columns)
        .groupBy(*[f"{side}_k{i}" for i in range(len(keys))])
        .agg(F.max_by("record", rank).alias(f"{side}_r"), F.count("*").alias(f"{side}_n"))
    )


def key_form(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return column.cast("string")
    if isinstance(kind, T.NumericType):
        return plain_number_text(column.try_cast(WIDE_NUMBER))
    return canon_key(column)


def join_form(column: Column, kind: T.DataType) -> Column:
    """Key form that is never NULL, so keys are compared by plain equality.

    Plain keys let the join use the partitioning of the aggregate before it; a null-safe comparison
    would shuffle both sides again.
    """
    return F.coalesce(key_form(column, kind), F.lit(NO_KEY))


def scalar_form(column: Column, kind: T.DataType, digits: int) -> Column:
    if isinstance(kind, T.NumericType):
        exact = column.try_cast(WIDE_NUMBER)
        return F.round(exact, digits).cast(f"decimal(38,{digits})").cast("string")
    return canon_scalar(column, digits)


def _same_keys(a: DataFrame, b: DataFrame, count: int) -> Column:
    same = F.lit(True)
    for i in range(count):
        term = a[f"preview_k{i}"] == b[f"baseline_k{i}"]
        same = term if i == 0 else same & term
    return same
