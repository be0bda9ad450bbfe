"""Project catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.errors import GateError
from ledgerspark.functions import nested


def read_projects(raw: DataFrame) -> DataFrame:
    """Projects from a configuration table whose cells may be wrapped JSON text."""
    return raw.select(
        F.coalesce(nested.first_text(F.col("project")), F.lit("")).alias("project"),
        F.coalesce(nested.first_text(F.col("project_name")), F.lit("")).alias("project_name"),
        nested.first_text(F.col("target_table")).alias("target_table"),
    )


def list_projects(projects: DataFrame, available_tables: DataFrame) -> DataFrame:
    """Projects with a flag that tells whether their target table exists."""
    known = available_tables.select(F.col("target_table"), F.lit(True).alias("found")).distinct()
    return projects.join(known, "target_table", "left").select(
        "project",
        "project_name",
        "target_table",
        F.coalesce("found", F.lit(False)).alias("target_exists"),
    )


# What keeps a project from being run, in the order the gates are passed.
NOT_REGISTERED = "is not registered"
NO_TARGET = "was not found"


def project_gates(requested: DataFrame, projects: DataFrame, must_exist: bool = True) -> DataFrame:
    """Per requested ``project`` the gate that stops it (``stopped``, NULL if none) and its target table.

    ``projects`` comes from ``list_projects``; of several entries of one project the first target counts.
    """
    known = projects.groupBy(F.col("project").alias("registered")).agg(
        F.min_by(F.struct("target_table", "target_exists"), F.struct(F.col("target_table").isNull(), "target_table")).alias("entry")
    )
    missing = F.coalesce(F.col("entry.target_table"), F.lit("")) == ""
    if must_exist:
        missing = missing | ~F.col("entry.target_exists")
    stopped = (
        F.when(F.col("registered").isNull(), F.concat(F.lit("project "), F.col("project"), F.lit(f" {NOT_REGISTERED}")))
        .when(missing, F.concat(F.lit("the target table of project "), F.col("project"), F.lit(f" {NO_TARGET}")))
    )
    return requested.select("project").distinct().join(known, F.col("project") == F.col("registered"), "left").select(
        "project", stopped.alias("stopped"), F.when(stopped.isNull(), F.col("entry.target_table")).alias("target_table")
    )


def require_target(projects: DataFrame, project: str, must_exist: bool = True) -> str:
    """Target table of a registered project, or the gate that stops it. ``projects`` comes from ``list_projects``."""
    asked = projects.sparkSession.createDataFrame([(project,)], "project string")
    found = project_gates(asked, projects.where(F.col("project") == project), must_exist).first()
    if found["stopped"]:
        raise GateError(found["stopped"])
    return found["target_table"]
