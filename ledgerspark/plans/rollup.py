"""Rule-driven rollup: GROUP rules, conditional SUM rules, row issues and release.

All sums of all rules of all sheets run in one partial/final aggregate over the source. Failing
rows are counted inside the same aggregate, so a clean run reads the source once; only a failing
run reads it again to list the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.errors import ConditionError, RollupIssues, RuleError
from ledgerspark.functions import conditions, values
from ledgerspark.functions.names import named
from ledgerspark.operators.backfill import fill_unique, merge_groups
from ledgerspark.plans.rules import SUM, Rule, RuleBundle, refuse_shared_sums
from ledgerspark.schemas import ISSUES
from ledgerspark.session import settle

# Fixed value: output name of the accounting period.
PERIOD = "period"

MISSING_FIELD = "Required field is missing."
SHARED_FIELD = "The field mapping is duplicated in the source file."
FAILED_CONDITION = "The condition could not be evaluated."

@dataclass(frozen=True)
class Source:
    """One column a rule or condition reads: its expression and where it exists."""

    column: Column
    kind: T.DataType = field(default_factory=T.StringType)
    present: Column | None = None


@dataclass(frozen=True)
class SheetInput:
    """A logical sheet with named columns.

    ``by_column`` finds the sources of a rule by (category, field); ``by_name`` finds what a
    condition may call by one name. More than one source means the name is ambiguous.
    """

    frame: DataFrame
    by_column: Callable[[str | None, str], list[Source]]
    by_name: Callable[[str], list[Source]]
    source_file: Column
    row_no: Column
    problems: DataFrame | None = None


def table_input(
    frame: DataFrame,
    categories: Mapping[str, tuple[str, str]] | None = None,
    source_file: str | None = None,
    row_no: str | None = None,
) -> SheetInput:
    """A DataFrame as a logical sheet. ``categories`` maps a column to its (category, field)."""
    kinds = {item.name: item.dataType for item in frame.schema.fields}
    placed = {name: (categories or {}).get(name, (None, name)) for name in frame.columns}

    def by_column(category: str | None, name: str) -> list[Source]:
        return [
            Source(named(column), kinds[column])
            for column, place in placed.items()
            if place == (category, name)
        ]

    def by_name(name: str) -> list[Source]:
        return [
            Source(named(column), kinds[column])
            for column, (category, base) in placed.items()
            if name == base or (category and name == f"{category}_{base}")
        ]

    nothing = F.lit(None)
    return SheetInput(
        frame=frame,
        by_column=by_column,
        by_name=by_name,
        source_file=(named(source_file) if source_file else nothing).cast("string"),
        row_no=(named(row_no) if row_no else nothing).cast("bigint"),
    )


@dataclass
class Rollup:
    """A planned rollup. Nothing runs before ``release`` or an action on one of the frames."""

    bundle: RuleBundle
    period: str
    rows: DataFrame
    groups: DataFrame
    group_ids: list[str]
    sum_ids: list[str]
    problems: DataFrame | None
    ordered: bool

    def issues(self) -> DataFrame:
        """Every row, file or rule that keeps the rollup from being released."""
        rows = self.rows.where("__issue is not null").select(
            "source_file",
            "sheet",
            "row_no",
            F.col("__issue.field").alias("field"),
            F.col("__issue.message").alias("message"),
        )
        return rows if self.problems is None else rows.unionByName(self.problems)

    def result(self) -> DataFrame:
        """Result of the aggregate alone, without backfill and without looking at issues."""
        return self._layout(self.groups)

    def release(self, backfill: bool = True) -> DataFrame:
        """The result table, or ``RollupIssues`` when anything is wrong with the input."""
        settled = settle(self.groups)
        failed = settled.agg(F.coalesce(F.sum("__failed"), F.lit(0))).first()[0]
        broken = 0 if self.problems is None else self.problems.count()
        if failed or broken:
            raise RollupIssues("the rollup was refused", self.issues(), failed + broken)
        if not backfill or not self.group_ids:
            return self._layout(settled)
        filled = fill_unique(settled, self.group_ids, settled=True)
        if self.ordered:
            first = F.min("__first").alias("__first")
            sums = [F.sum(name).alias(name) for name in self.sum_ids]
            merged = filled.groupBy(*self.group_ids).agg(*sums, first)
        else:
            merged = merge_groups(filled, self.group_ids, self.sum_ids)
        return self._layout(merged)

    def _layout(self, groups: DataFrame) -> DataFrame:
        keys = [F.col(i).alias(n) for i, n in zip(self.group_ids, self.bundle.group_fields)]
        sums = [
            F.coalesce(F.round(F.col(i), 2), F.lit(0)).cast("decimal(38,2)").alias(n)
            for i, n in zip(self.sum_ids, self.bundle.sum_fields)
        ]
        if self.ordered:
            groups = groups.orderBy("__first")
        return groups.select(F.lit(self.period).alias(PERIOD), *keys, *sums)


def plan_rollup(
    inputs: Mapping[str, SheetInput],
    bundle: RuleBundle,
    period: str,
    ordered: bool = False,
) -> Rollup:
    """Bind the rules of ``bundle`` to named sheets and plan the aggregate for ``period``.

    ``ordered`` carries the first place each group was seen (file, sheet, row) and sorts the result
    by it. It costs a wider aggregate, so it is off unless people read the result.
    """
    refuse_shared_sums(bundle)
    month = normal_period(period)
    groups, outputs = bundle.groups, bundle.sum_fields
    group_ids = [f"g{i}" for i in range(len(groups))]
    sum_ids = [f"s{i}" for i in range(len(outputs))]
    slot = dict(zip(outputs, sum_ids))

    bindings = [_Binding(sheet, given, month) for sheet, given in inputs.items()]
    if not bindings:
        raise RuleError("no sheet was given")
    summed: list[dict[str, _Summand]] = []
    keyed: list[dict[str, Column | None]] = []
    for bound in bindings:
        mine = [rule for rule in bundle.rules if rule.applies_to(bound.sheet)]
        keyed.append(
            {i: bound.group(r) if r in mine else None for i, r in zip(group_ids, groups)}
        )
        summed.append({slot[r.output]: bound.sum(r) for r in mine if r.kind == SUM})
    # A sum runs on bigint parts when no sheet feeds it with text or decimals.
    is_split = {i: all(part[i].is_split for part in summed if i in part) for i in sum_ids}
    is_wide = {i: is_split[i] and any(part[i].wide is not None for part in summed if i in part) for i in sum_ids}

    parts: list[DataFrame] = []
    problems: list[DataFrame] = []
    none = F.lit(None)
    for place, (bound, keys, sums) in enumerate(zip(bindings, keyed, summed)):
        amounts: list[Column] = []
        for i in sum_ids:
            for name, kind in _parts_of(i, is_split[i], is_wide[i]):
                column = sums[i].part(name, is_split[i]) if i in sums else none
                amounts.append(column.cast(kind).alias(name))
        parts.append(
            bound.prepared().select(
                *[(none if c is None else c).cast("string").alias(i) for i, c in keys.items()],
                *amounts,
                bound.issue().alias("__issue"),
                bound.given.source_file.alias("source_file"),
                bound.given.row_no.alias("row_no"),
                F.lit(bound.sheet).alias("sheet"),
                F.lit(place).alias("__place"),
            )
        )
        problems += bound.problems()

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    measures = [
        F.sum(name).alias(name) for i in sum_ids for name, _ in _parts_of(i, is_split[i], is_wide[i])
    ]
    measures.append(F.count_if(F.col("__issue").isNotNull()).alias("__failed"))
    if ordered:
        first = F.min(F.struct("source_file", "__place", "row_no"))
        measures.append(first.alias("__first"))
    totals = [
        (
            values.joined_number(F.col(f"{i}u"), F.col(f"{i}m"), F.col(f"{i}w") if is_wide[i] else None)
            if is_split[i]
            else F.col(i)
        ).alias(i)
        for i in sum_ids
    ]
    extra = ["__failed", "__first"] if ordered else ["__failed"]
    merged = None
    for problem in problems:
        merged = problem if merged is None else merged.unionByName(problem)
    return Rollup(
        bundle=bundle,
        period=month,
        rows=rows,
        groups=rows.groupBy(*group_ids).agg(*measures).select(*group_ids, *totals, *extra),
        group_ids=group_ids,
        sum_ids=sum_ids,
        problems=merged,
        ordered=ordered,
    )


def _parts_of(sum_id: str, is_split: bool, is_wide: bool) -> list[tuple[str, str]]:
    if is_split:
        parts = [(f"{sum_id}u", "bigint"), (f"{sum_id}m", "bigint")]
        return [*parts, (f"{sum_id}w", values.NUMBER)] if is_wide else parts
    return [(sum_id, values.NUMBER)]


def normal_period(period: str | int | None) -> str:
    """A six-digit period, checked on the driver; None stands for the validation period."""
    text = values.VALIDATION_PERIOD if period is None else str(period).strip()
    if len(text) != 6 or not text.isdigit() or not 1 <= int(text[4:]) <= 12:
        raise ConditionError(conditions.CODE_RUNTIME, "the period must be a YYYYMM text")
    return text


@dataclass(frozen=True)
class _Summand:
    """What a SUM rule adds per row: a decimal, and for native numbers its two bigint parts.

    ``wide`` is what doubles too wide for those add instead.
    """

    number: Column
    applies: Column | None = None
    units: Column | None = None
    millionths: Column | None = None
    wide: Column | None = None

    @property
    def is_split(self) -> bool:
        return self.units is not None

    def part(self, name: str, split: bool) -> Column:
        column = self.number
        if split:
            parts = {"u": self.units, "m": self.millionths, "w": F.lit(None) if self.wide is None else self.wide}
            column = parts[name[-1]]
        return column if self.applies is None else F.when(self.applies, column)


class _Binding:
    """Rules of one sheet turned into columns, with the failures they can meet.

    Conditions and numbers become columns of their own first, layer by layer. Several rules and
    the failure tests read them, and this way each is computed once per row. It also keeps the
    generated methods below the size the JVM still compiles.
    """

    def __init__(self, sheet: str, given: SheetInput, period: str) -> None:
        self.sheet = sheet
        self.given = given
        self.period = period
        self._first: dict[str, Column] = {}
        self._second: dict[str, Column] = {}
        self._numbers: dict[tuple[str | None, str], tuple[Column, Column]] = {}
        self._failures: list[Column] = []
        self._notes: list[tuple[str, str]] = []

    def prepared(self) -> DataFrame:
        """The sheet with all conditions and all split numbers as columns."""
        frame = self.given.frame
        for layer in (self._first, self._second):
            frame = frame.withColumns(layer) if layer else frame
        return frame

    def group(self, rule: Rule) -> Column | None:
        source = self._one(rule)
        return None if source is None else group_text(source)

    def sum(self, rule: Rule) -> _Summand:
        nothing = _Summand(F.lit(None), None, F.lit(None), F.lit(None))
        source = self._one(rule)
        if source is None:
            return nothing
        applies = source.present
        try:
            term = conditions.build(rule.condition, self._lookup, self.period)
        except ConditionError as error:
            self._notes.append((error.field or rule.field, str(error)))
            return nothing
        if term is not None:
            holds = self._keep(term.value)
            if term.bad is not None:
                self._fail(both(applies, self._keep(term.bad)), None, FAILED_CONDITION)
            applies = both(applies, holds)
        made = self._number(rule, source)
        if made.empty is not None:
            self._fail(both(applies, made.empty), rule.field, f"SUM field '{rule.field}' is empty.")
        if made.unreadable is not None:
            message = f"SUM field '{rule.field}' is not a number."
            self._fail(both(applies, made.unreadable), rule.field, message)
        return _Summand(made.number, applies, made.units, made.millionths, made.wide)

    def issue(self) -> Column:
        """First failure of the row, NULL for a good row."""
        if not self._failures:
            return F.lit(None).cast("struct<field:string,message:string>")
        return F.coalesce(*self._failures)

    def problems(self) -> list[DataFrame]:
        found = [] if self.given.problems is None else [self.given.problems]
        if self._notes:
            spark = self.given.frame.sparkSession
            lines = [(None, self.sheet, None, name, message) for name, message in self._notes]
            found.append(spark.createDataFrame(lines, ISSUES))
        return found

    def _number(self, rule: Rule, source: Source) -> _Number:
        place = (rule.category, rule.field)
        if not isinstance(source.kind, T.NumericType):
            if place not in self._numbers:
                text = self._keep(values.numeric_text(source.column.cast("string")))
                number = self._keep(text.try_cast(values.NUMBER), self._second)
                self._numbers[place] = (text, number)
            return text_number(*self._numbers[place], rule.optional)
        if not isinstance(source.kind, (T.FloatType, T.DoubleType)):
            return whole_number(source, rule.optional)
        if place not in self._numbers:
            value = source.column.cast("double")
            large = self._keep(values.large_number(value))
            parts = values.split_number(value, large)
            self._numbers[place] = tuple(self._keep(p, self._second) for p in parts)
        units, millionths, wide = self._numbers[place]
        column = source.column
        empty = None if rule.optional else column.isNull()
        unreadable = column.isNotNull() & units.isNull()
        return _Number(column.try_cast(values.NUMBER), empty, unreadable, units, millionths, wide)

    def _keep(self, column: Column, layer: dict[str, Column] | None = None) -> Column:
        name = f"__c{len(self._first) + len(self._second)}"
        (self._first if layer is None else layer)[name] = column
        return F.col(name)

    def _one(self, rule: Rule) -> Source | None:
        found = self.given.by_column(rule.category, rule.field)
        if len(found) == 1:
            return found[0]
        if found:
            self._notes.append((rule.field, SHARED_FIELD))
        elif not rule.optional:
            self._notes.append((rule.field, MISSING_FIELD))
        return None

    def _lookup(self, name: str) -> conditions.Term:
        found = self.given.by_name(name)
        if len(found) != 1:
            raise ConditionError(
                conditions.CODE_UNRESOLVED, f"the condition names an unknown field: {name}", name
            )
        return conditions.Term(found[0].column, kind=found[0].kind)

    def _fail(self, where: Column, name: str | None, message: str) -> None:
        note = F.struct(F.lit(name).cast("string").alias("field"), F.lit(message).alias("message"))
        self._failures.append(F.when(where, note))


def both(left: Column | None, right: Column) -> Column:
    return right if left is None else left & right


@dataclass(frozen=True)
class _Number:
    """A source as a number, with the tests for empty and unreadable cells where they can occur."""

    number: Column
    empty: Column | None
    unreadable: Column | None
    units: Column | None = None
    millionths: Column | None = None
    wide: Column | None = None


def text_number(text: Column, number: Column, optional: bool) -> _Number:
    """A text cell from its normalized text and the number read from it."""
    empty = F.coalesce(text == "", F.lit(True))
    unreadable = ~empty & number.isNull()
    if not optional:
        return _Number(number, empty, unreadable)
    zero = F.lit(0).cast(values.NUMBER)
    return _Number(F.when(empty, zero).otherwise(number), None, unreadable)


def whole_number(source: Source, optional: bool) -> _Number:
    """An integer or decimal column."""
    column, kind = source.column, source.kind
    number = column.try_cast(values.NUMBER)
    empty = None if optional else column.isNull()
    if isinstance(kind, T.IntegralType):
        if isinstance(kind, T.LongType):
            # Two cells can already exceed a bigint sum; decimals hold 32 digits.
            return _Number(number, empty, None)
        return _Number(number, empty, None, column.cast("bigint"), F.lit(0).cast("bigint"))
    return _Number(number, empty, column.isNotNull() & number.isNull())


def group_text(source: Source) -> Column:
    """Key text: an empty cell is no key, numbers carry no trailing zeros."""
    column, kind = source.column, source.kind
    if isinstance(kind, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        exact = column.try_cast(values.WIDE_NUMBER).cast("string")
        return F.regexp_replace(exact, r"\.?0+$", "")
    return column.cast("string")
