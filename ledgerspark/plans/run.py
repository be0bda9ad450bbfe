"""The stages of a rollup job, alone or one after the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import load
from ledgerspark.plans.rollup import PERIOD, plan_rollup
from ledgerspark.plans.rules import PatchBook, RuleBundle, load_bundle, refuse_shared_sums
from ledgerspark.plans.validate import (
    expected_target_fields,
    require_all_passed,
    source_checks,
    target_checks,
)
from ledgerspark.sources.config import list_projects, require_target
from ledgerspark.sources.grid import sheet_input

DEFAULT, APPEND, UPSERT = "default", "append", "upsert"


@dataclass(frozen=True)
class Setup:
    """Configuration tables of a job. ``patches`` adjust the rules of single projects."""

    projects: DataFrame
    specs: DataFrame
    rules: DataFrame
    target_fields: DataFrame
    patches: PatchBook

    def bundle(self, project: str) -> RuleBundle:
        bundle = self.patches.apply(load_bundle(self.specs, self.rules, project))
        return refuse_shared_sums(bundle)

    def target_table(self, project: str) -> str:
        tables = self.target_fields.select("target_table")
        return require_target(list_projects(self.projects, tables), project)


def validate(setup: Setup, project: str, grid: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Report of all source and target checks, or ``ValidationFailed``."""
    setup.target_table(project)
    bundle = setup.bundle(project)
    mine = F.col("project") == project
    rules = _rules_frame(grid.sparkSession, bundle)
    expected = expected_target_fields(setup.projects.where(mine), rules)
    targets = target_checks(expected, setup.target_fields).drop("project")
    return require_all_passed(source_checks(grid, bundle, inventory).unionByName(targets))


def preview(
    setup: Setup, project: str, grid: DataFrame, period: str, inventory: DataFrame | None = None
) -> DataFrame:
    """The released rollup of all files of ``grid``, or ``RollupIssues``."""
    bundle = setup.bundle(project)
    inputs = {spec.sheet: sheet_input(grid, spec, bundle.rules, inventory) for spec in bundle.sheets}
    return plan_rollup(inputs, bundle, period).release()


def upload(
    setup: Setup, project: str, artifact: str, target_path: str, strategy: str = DEFAULT
) -> DataFrame:
    """Load an artifact into the target; returns its row and field count."""
    spark = setup.projects.sparkSession
    result, metadata = load.read_artifact(spark, artifact, project)
    setup.target_table(project)
    period = metadata["period"]
    keys = [PERIOD, *metadata["group_fields"]]
    if strategy == UPSERT:
        load.upsert(spark, result, target_path, period, keys)
    else:
        if strategy == DEFAULT:
            load.require_empty_period(spark.read.parquet(target_path), period)
        load.append(result.withColumn(load.RECORD_ID, F.uuid()), target_path)
    return load.overview(result)


def run_full(
    setup: Setup,
    project: str,
    grid: DataFrame,
    period: str,
    folder: str,
    target_path: str,
    strategy: str = DEFAULT,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Validate, roll up and load; the first stage that refuses ends the job."""
    validate(setup, project, grid, inventory)
    result = preview(setup, project, grid, period, inventory)
    groups = setup.bundle(project).group_fields
    artifact = load.write_artifact(result, folder, project, period, groups)
    return upload(setup, project, artifact, target_path, strategy)


def _rules_frame(spark: SparkSession, bundle: RuleBundle) -> DataFrame:
    rows = [(bundle.project, r.output, r.kind, i) for i, r in enumerate(bundle.rules)]
    return spark.createDataFrame(rows, "project string, output string, kind string, rule_no int")
