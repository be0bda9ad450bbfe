"""Column layouts of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


GRID = _struct(source_file=STRING, sheet=STRING, row_no=LONG, cells=T.ArrayType(STRING))
CELLS = _struct(source_file=STRING, sheet=STRING, row_no=LONG, col_no=INT, value=STRING)
MERGE_RANGES = _struct(
    source_file=STRING, sheet=STRING, min_row=LONG, max_row=LONG, min_col=INT, max_col=INT
)
HEADER = _struct(source_file=STRING, sheet=STRING, col_idx=INT, category=STRING, field=STRING)
PROJECTS = _struct(project=STRING, project_name=STRING, target_table=STRING)
SHEET_SPECS = _struct(
    project=STRING, sheet=STRING, category_row=INT, field_row=INT, last_row=INT, optional=BOOL
)
RULES = _struct(
    project=STRING,
    output=STRING,
    kind=STRING,
    sheet=STRING,
    category=STRING,
    field=STRING,
    condition=STRING,
    optional=BOOL,
)
TARGET_FIELDS = _struct(target_table=STRING, field_name=STRING, type=INT)
ISSUES = _struct(source_file=STRING, sheet=STRING, row_no=LONG, field=STRING, message=STRING)
CHECKS = _struct(
    check_name=STRING,
    scope=STRING,
    passed=BOOL,
    message=STRING,
    details=T.MapType(STRING, STRING),
)
SESSION_LINES = _struct(session_file=STRING, line_no=LONG, raw=STRING)
