"""Rules, sheet layouts and the checks a rule table must pass before it is used.

A rule table has tens of rows per project, so a bundle is held on the driver and turned into
columns once. The same checks exist as DataFrame jobs for whole rule catalogs of many projects.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.errors import RuleError
from ledgerspark.functions import nested
from ledgerspark.functions.conditions import Condition
from ledgerspark.functions.values import WHITESPACE, strip

# The sheet name that stands for "the only sheet", and the virtual source column.
DEFAULT_SHEET = "DEFAULT"
FILE_NAME = "FILE_NAME"
GROUP, SUM = "GROUP", "SUM"


@dataclass(frozen=True)
class Rule:
    output: str
    kind: str
    sheet: str
    field: str
    category: str | None = None
    condition: Condition | None = None
    optional: bool = False

    @property
    def sheets(self) -> list[str]:
        return [name.strip() for name in self.sheet.split(",") if name.strip()]

    def applies_to(self, sheet: str) -> bool:
        return sheet in self.sheets


@dataclass(frozen=True)
class SheetSpec:
    sheet: str
    field_row: int = 1
    last_row: int = -1
    category_row: int | None = None
    optional: bool = False

    @property
    def anchor_row(self) -> int:
        """Last header row; data starts below it."""
        return max(self.category_row or 0, self.field_row)


@dataclass(frozen=True)
class RuleBundle:
    project: str
    sheets: tuple[SheetSpec, ...]
    rules: tuple[Rule, ...]

    @property
    def groups(self) -> list[Rule]:
        """GROUP rules; the first rule of an output name stands for it in the result layout."""
        return first_per_output([rule for rule in self.rules if rule.kind == GROUP])

    @property
    def sums(self) -> list[Rule]:
        return [rule for rule in self.rules if rule.kind == SUM]

    @property
    def group_fields(self) -> list[str]:
        return [rule.output for rule in self.groups]

    @property
    def sum_fields(self) -> list[str]:
        return list(dict.fromkeys(rule.output for rule in self.sums))


def first_per_output(rules: list[Rule]) -> list[Rule]:
    kept: dict[str, Rule] = {}
    for rule in rules:
        kept.setdefault(rule.output, rule)
    return list(kept.values())


Patch = Callable[[RuleBundle], RuleBundle]


class PatchBook:
    """Functions that adjust the rules of one project, applied in the order of registration."""

    def __init__(self) -> None:
        self._patches: dict[str, list[Patch]] = {}

    def register(self, project: str, patch: Patch) -> None:
        self._patches.setdefault(project, []).append(patch)

    def apply(self, bundle: RuleBundle) -> RuleBundle:
        for patch in self._patches.get(bundle.project, []):
            bundle = patch(bundle)
        return bundle


def add_rule(rule: Rule) -> Patch:
    return lambda bundle: replace(bundle, rules=(*bundle.rules, rule))


def refuse_shared_sums(bundle: RuleBundle) -> RuleBundle:
    """A SUM output may come from one rule only; combining facts is left to later steps."""
    counts = Counter(rule.output for rule in bundle.sums)
    shared = sorted(output for output, n in counts.items() if n > 1)
    if shared:
        raise RuleError(f"more than one SUM rule feeds: {', '.join(shared)}")
    return bundle


def read_specs(raw: DataFrame) -> DataFrame:
    """Sheet layouts from a configuration table whose cells may be wrapped JSON text."""
    return raw.select(
        _project(raw).alias("project"),
        F.coalesce(nested.first_text(F.col("sheet")), F.lit("")).alias("sheet"),
        _whole(F.col("category_row")).alias("category_row"),
        F.coalesce(_whole(F.col("field_row")), F.lit(0)).alias("field_row"),
        F.coalesce(_whole(F.col("last_row")), F.lit(0)).alias("last_row"),
        nested.flag(F.col("optional")).alias("optional"),
    )


def read_rules(raw: DataFrame) -> DataFrame:
    """Rules from a configuration table whose cells may be wrapped JSON text."""
    def text(name: str) -> Column:
        return nested.first_text(F.col(name))

    return raw.select(
        _project(raw).alias("project"),
        F.coalesce(text("output"), F.lit("")).alias("output"),
        F.upper(F.coalesce(text("kind"), F.lit(""))).alias("kind"),
        F.coalesce(text("sheet"), F.lit("")).alias("sheet"),
        text("category").alias("category"),
        F.coalesce(text("field"), F.lit("")).alias("field"),
        text("condition").alias("condition"),
        nested.flag(F.col("optional")).alias("optional"),
    )


def load_bundle(specs: DataFrame, rules: DataFrame, project: str) -> RuleBundle:
    """The bundle of one project, in table order where the table carries a ``rule_no`` column."""
    chosen_specs = _of_project(specs, project)
    chosen_rules = _of_project(rules, project)
    return RuleBundle(
        project=project,
        sheets=tuple(
            SheetSpec(
                sheet=row["sheet"],
                field_row=row["field_row"],
                last_row=row["last_row"],
                category_row=row["category_row"],
                optional=bool(row["optional"]),
            )
            for row in chosen_specs
        ),
        rules=tuple(
            Rule(
                output=row["output"],
                kind=row["kind"],
                sheet=row["sheet"],
                field=row["field"],
                category=row["category"],
                condition=row["condition"],
                optional=bool(row["optional"]),
            )
            for row in chosen_rules
        ),
    )


def _of_project(table: DataFrame, project: str) -> list:
    chosen = table.where(F.col("project") == project)
    if "rule_no" in table.columns:
        chosen = chosen.orderBy("rule_no")
    return chosen.collect()


def _project(raw: DataFrame) -> Column:
    """Project id; ``recognition_id`` is accepted where ``recog_id`` is empty."""
    names = [name for name in ("recog_id", "recognition_id") if name in raw.columns]
    return F.coalesce(*[nested.first_text(F.col(name)) for name in names])


def _whole(raw: Column) -> Column:
    return nested.whole_number(nested.first_text(raw)).cast("int")


# The same checks over whole catalogs.


def applicable_sheets(rules: DataFrame) -> DataFrame:
    """One row per rule and logical sheet it applies to."""
    names = F.transform(F.split("sheet", ","), lambda name: F.btrim(name, F.lit(WHITESPACE)))
    return rules.withColumn("logical_sheet", F.explode(F.filter(names, lambda n: n != "")))


def first_rule_per_output(rules: DataFrame, order: str = "rule_no") -> DataFrame:
    """GROUP rules of every project, one per output name; the lowest ``order`` wins."""
    kept = [name for name in rules.columns if name not in ("project", "output")]
    first = (
        rules.where(F.col("kind") == GROUP)
        .groupBy("project", "output")
        .agg(F.min_by(F.struct(*kept), F.col(order)).alias("first"))
    )
    return first.select("project", "output", "first.*")


def shared_sum_outputs(rules: DataFrame) -> DataFrame:
    """SUM outputs that more than one rule of a project feeds."""
    return (
        rules.where(F.col("kind") == SUM)
        .groupBy("project", "output")
        .agg(F.count("*").alias("rule_count"))
        .where("rule_count > 1")
    )


def duplicate_ids(table: DataFrame, column: str) -> DataFrame:
    return (
        table.groupBy(strip(F.col(column)).alias(column))
        .agg(F.count("*").alias("occurrences"))
        .where("occurrences > 1")
    )
