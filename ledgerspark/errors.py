"""Typed errors raised while a job is planned or released."""

from __future__ import annotations

from pyspark.sql import DataFrame


class LedgerError(Exception):
    """Base class."""


class SourceError(LedgerError):
    """The source path, its file types or its encoding cannot be used."""


class RuleError(LedgerError):
    """The rule table asks for something the rollup does not support."""


class ConditionError(LedgerError):
    """A rule condition cannot be turned into a column. ``code`` is stable for reports."""

    def __init__(self, code: str, message: str, field: str | None = None) -> None:
        super().__init__(message)
        self.code = code
        self.field = field


class ReportError(LedgerError):
    """A stage was refused. ``report`` is a lazy DataFrame that holds every reason."""

    def __init__(self, message: str, report: DataFrame, count: int | None = None) -> None:
        super().__init__(message)
        self.report = report
        self.count = count


class RollupIssues(ReportError):
    """Rows or files of the source could not be rolled up."""


class ValidationFailed(ReportError):
    """At least one validation check failed."""


class PeriodConflict(ReportError):
    """The target already holds rows of the period."""


class GateError(LedgerError):
    """Project or target table is not registered, or an artifact belongs to another project."""
