"""Grids to named columns.

A grid is one row per sheet row: ``source_file, sheet, row_no, cells``. Headers differ from file to
file, so column positions are data: they are found by one aggregate per (file, sheet) and joined
back to the rows. Nothing about a file passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.errors import ConditionError
from ledgerspark.functions.conditions import CODE_UNRESOLVED, referenced_names
from ledgerspark.functions.names import named
from ledgerspark.functions.values import blank_to_null, clean_cell
from ledgerspark.plans.rollup import MISSING_FIELD, SHARED_FIELD, SheetInput, Source
from ledgerspark.plans.rules import DEFAULT_SHEET, FILE_NAME, Rule, SheetSpec
from ledgerspark.session import lookup_side, settle, store

FILE_KEY = ["source_file", "sheet"]
VIRTUAL = -1
# Rows of a sheet that share the ranges they are compared with.
ROWS_OF_BUCKET = 256

# Messages of the range checks and the sheet checks.
MISSING_SHEET = "Required sheet is missing."
DEFAULT_NEEDS_ONE = (
    "DEFAULT logical sheet can only be used when the workbook has exactly one sheet."
)
NO_ROWS = "No rows were found in "
CSV_NEEDS_DEFAULT = "CSV files must use the DEFAULT logical sheet."
RANGE_MESSAGES = {
    "zero": "last_row cannot be zero.",
    "positive": "field_row and last_row must resolve to positive row numbers.",
    "category": "category_row must resolve to a positive row number when provided.",
    "field_late": "field_row exceeds the actual file row count.",
    "category_late": "category_row exceeds the actual file row count.",
    "last_late": "last_row exceeds the actual file row count.",
    "empty": "The data range is empty after applying category_row, field_row, and last_row.",
}


def file_stem(source_file: Column) -> Column:
    name = F.element_at(F.split(source_file, "/"), -1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def grid_from_cells(cells: DataFrame) -> DataFrame:
    """Rows of cells to a grid. Columns a row does not mention are NULL."""
    return (
        cells.groupBy(*FILE_KEY, "row_no")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("by_col"),
            F.max("col_no").alias("width"),
        )
        .select(
            *FILE_KEY,
            "row_no",
            F.transform(F.sequence(F.lit(1), "width"), lambda c: F.col("by_col")[c]).alias("cells"),
        )
    )


def expand_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give every coordinate of a merged range the value of its top-left cell.

    Cells meet the ranges of their rows' bucket, so a range is a row per bucket and not one per coordinate.
    Coordinates are only written out for ranges that do not hold a cell at each of them; there the rows
    are part of the result.
    """
    bucket = lambda row: F.expr(f"{row} div {ROWS_OF_BUCKET}")
    corner = cells.select(
        *FILE_KEY,
        F.col("row_no").alias("min_row"),
        F.col("col_no").alias("min_col"),
        F.col("value").alias("corner_value"),
    )
    known = settle(
        ranges.dropDuplicates([*FILE_KEY, "min_row", "min_col"]).join(corner, [*FILE_KEY, "min_row", "min_col"], "left")
    )
    spread = lookup_side(
        known.select(*[F.col(name).alias(f"of_{name}") for name in known.columns]).withColumn(
            "of_bucket", F.explode(F.sequence(bucket("of_min_row"), bucket("of_max_row")))
        )
    )
    inside = F.col("row_no").between(F.col("of_min_row"), F.col("of_max_row")) & F.col("col_no").between(
        F.col("of_min_col"), F.col("of_max_col")
    )
    same = (F.col("source_file") == F.col("of_source_file")) & (F.col("sheet") == F.col("of_sheet"))
    met = store(cells.join(spread, same & (bucket("row_no") == F.col("of_bucket")) & inside, "left"), "merged")
    covered = F.col("of_min_row").isNotNull()
    shown = met.select(
        *FILE_KEY, "row_no", "col_no", F.when(covered, F.col("of_corner_value")).otherwise(F.col("value")).alias("value")
    )
    # Ranges with coordinates that have no cell of their own.
    held = met.where(covered).groupBy("of_source_file", "of_sheet", "of_min_row", "of_min_col").agg(
        F.countDistinct("row_no", "col_no").alias("held")
    )
    size = (F.col("max_row") - F.col("min_row") + 1).cast("long") * (F.col("max_col") - F.col("min_col") + 1)
    gaps = settle(
        known.join(
            lookup_side(held),
            (F.col("source_file") == F.col("of_source_file")) & (F.col("sheet") == F.col("of_sheet"))
            & (F.col("min_row") == F.col("of_min_row")) & (F.col("min_col") == F.col("of_min_col")),
            "left",
        ).where(size > F.coalesce("held", F.lit(0))).select(*known.columns)
    )
    if gaps.isEmpty():
        return shown
    missing = (
        gaps.select(*FILE_KEY, "corner_value", "min_col", "max_col", F.explode(F.sequence("min_row", "max_row")).alias("row_no"))
        .select(*FILE_KEY, "row_no", F.explode(F.sequence("min_col", "max_col")).alias("col_no"), "corner_value")
        .join(cells, [*FILE_KEY, "row_no", "col_no"], "left_anti")
    )
    return shown.unionByName(missing.select(*FILE_KEY, "row_no", "col_no", F.col("corner_value").alias("value")))


def sheet_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*FILE_KEY).agg(F.count("*").alias("total_rows"))


def named_sheet(grid: DataFrame, spec: SheetSpec) -> DataFrame:
    """Rows that may belong to a logical sheet; for DEFAULT that is every row."""
    return grid if spec.sheet == DEFAULT_SHEET else grid.where(F.col("sheet") == spec.sheet)


def single_sheet_files(grid: DataFrame) -> DataFrame:
    """Files with exactly one sheet, the only ones DEFAULT can stand for."""
    sheets = grid.groupBy("source_file").agg(
        F.min("sheet").alias("low"), F.max("sheet").alias("high")
    )
    return sheets.where("low = high").select("source_file")


def pick_sheet(grid: DataFrame, spec: SheetSpec) -> DataFrame:
    """Rows of a logical sheet. For DEFAULT these are the files that have exactly one sheet."""
    if spec.sheet != DEFAULT_SHEET:
        return named_sheet(grid, spec)
    return grid.join(lookup_side(single_sheet_files(grid)), "source_file", "left_semi")


def sheet_bounds(grid: DataFrame, spec: SheetSpec, inventory: DataFrame | None = None) -> DataFrame:
    """Per file: total rows, the resolved last row and the reason why the range is not usable.

    One aggregate over the grid answers for every file whether the sheet exists, too. A file of the
    ``inventory`` that has no rows is not in the grid; it is reported as well.
    """
    is_default = spec.sheet == DEFAULT_SHEET
    chosen = F.lit(True) if is_default else F.col("sheet") == spec.sheet
    per_file = grid.groupBy("source_file").agg(
        F.count_if(chosen).alias("total_rows"),
        F.min(F.when(chosen, F.col("sheet"))).alias("sheet"),
        F.max(F.when(chosen, F.col("sheet"))).alias("high"),
    )
    no_rows = F.lit(False)
    if inventory is not None:
        listed = inventory.select(F.col("path").alias("source_file")).distinct()
        per_file = listed.join(per_file.withColumn("has_rows", F.lit(True)), "source_file", "left")
        no_rows = F.col("has_rows").isNull()
        per_file = per_file.withColumn("total_rows", F.coalesce("total_rows", F.lit(0)).cast("bigint"))
    total = F.col("total_rows")
    last = total + spec.last_row + 1 if spec.last_row < 0 else F.lit(spec.last_row).cast("bigint")
    is_csv = F.lower("source_file").endswith(".csv")
    not_default = F.lit(not is_default)
    return (
        per_file.withColumn("resolved_last_row", last)
        .withColumn(
            "message",
            F.when(is_csv & not_default, F.lit(CSV_NEEDS_DEFAULT))
            .when(no_rows, F.concat(F.lit(NO_ROWS), F.col("source_file"), F.lit(".")))
            .when(total == 0, F.lit(MISSING_SHEET))
            .when(F.lit(is_default) & (F.col("sheet") != F.col("high")), F.lit(DEFAULT_NEEDS_ONE))
            .otherwise(range_message(total, spec)),
        )
        .withColumn("exists", (total > 0) & ~(is_csv & not_default))
        .drop("high", "has_rows")
    )


def range_message(total: Column, spec: SheetSpec) -> Column:
    """Why a row range cannot be used, NULL if it can."""
    if spec.last_row == 0:
        return F.lit(RANGE_MESSAGES["zero"])
    last = total + spec.last_row + 1 if spec.last_row < 0 else F.lit(spec.last_row)
    start = spec.anchor_row + 1
    header_only = (
        (F.lit(start) == total + 1) & (last == total) if spec.last_row == -1 else F.lit(False)
    )
    category = spec.category_row
    checks = [
        (F.lit(spec.field_row < 1) | (last < 1), "positive"),
        (F.lit(category is not None and category < 1), "category"),
        (F.lit(spec.field_row) > total, "field_late"),
        (F.lit(category or 0) > total, "category_late"),
        (last > total, "last_late"),
        ((F.lit(start) > last) & ~header_only, "empty"),
    ]
    return F.coalesce(*[F.when(test, F.lit(RANGE_MESSAGES[name])) for test, name in checks])


def resolve_header(rows: DataFrame, spec: SheetSpec) -> DataFrame:
    """Column descriptors per file: position, category and field, and the virtual file name.

    With a category row the header is the field row and the row right above it.
    """
    wanted = [spec.field_row] if spec.category_row is None else [spec.field_row - 1, spec.field_row]
    text = blank_to_null(F.col("cell"))
    heads = (
        rows.where(F.col("row_no").isin(wanted))
        .select(*FILE_KEY, "row_no", F.posexplode("cells").alias("col_idx", "cell"))
        .groupBy(*FILE_KEY, "col_idx")
        .agg(
            F.max(F.when(F.col("row_no") == spec.field_row, text)).alias("here"),
            F.max(F.when(F.col("row_no") == spec.field_row - 1, text)).alias("above"),
        )
    )
    if spec.category_row is None:
        category, field = F.lit(None).cast("string"), F.col("here")
    else:
        same = F.col("here") == F.col("above")
        category = F.when(F.col("here").isNull() | same, F.lit(None)).otherwise(F.col("above"))
        field = F.coalesce("here", "above")
    found = heads.select(*FILE_KEY, "col_idx", category.alias("category"), field.alias("field"))
    found = found.where(F.col("field").isNotNull())
    # A physical column named like the virtual one takes its place.
    plain_name = F.col("category").isNull() & (F.col("field") == FILE_NAME)
    taken = found.where(plain_name).select(*FILE_KEY)
    virtual = (
        rows.where(F.col("row_no").isin(wanted))
        .select(*FILE_KEY)
        .distinct()
        .join(taken, FILE_KEY, "left_anti")
        .select(
            *FILE_KEY,
            F.lit(VIRTUAL).alias("col_idx"),
            F.lit(None).cast("string").alias("category"),
            F.lit(FILE_NAME).alias("field"),
        )
    )
    return found.unionByName(virtual)


def duplicate_headers(header: DataFrame) -> DataFrame:
    return (
        header.groupBy(*FILE_KEY, F.coalesce("category", F.lit("")).alias("category"), "field")
        .agg(F.count("*").alias("occurrences"))
        .where("occurrences > 1")
    )


def data_rows(rows: DataFrame, spec: SheetSpec) -> DataFrame:
    """Rows below the header through ``last_row``. Totals are only joined where they matter."""
    below = rows.where(F.col("row_no") > spec.anchor_row)
    if spec.last_row == -1:
        return below
    if spec.last_row > 0:
        return below.where(F.col("row_no") <= spec.last_row)
    last = sheet_totals(rows).select(
        *FILE_KEY, (F.col("total_rows") + spec.last_row + 1).alias("resolved_last_row")
    )
    kept = below.join(lookup_side(last), FILE_KEY).where("row_no <= resolved_last_row")
    return kept.drop("resolved_last_row")


def cell_at(position: Column, cells: Column, stem: Column) -> Column:
    """Clean cell text at a zero-based position; short rows give NULL."""
    text = clean_cell(F.try_element_at(cells, position + 1))
    return F.when(position == VIRTUAL, stem).when(position >= 0, text)


def long_cells(rows: DataFrame, header: DataFrame) -> DataFrame:
    """One row per data row and named column."""
    return rows.join(lookup_side(header), FILE_KEY).select(
        *FILE_KEY,
        "row_no",
        "col_idx",
        "category",
        "field",
        cell_at(F.col("col_idx"), F.col("cells"), file_stem(F.col("source_file"))).alias("value"),
    )


def matches(category: str | None, field: str) -> Column:
    """Header columns a rule means; a rule without category only means uncategorized columns."""
    return (F.col("field") == field) & F.col("category").eqNullSafe(F.lit(category))


def called(name: str) -> Column:
    """Header columns a condition means: by field, or by category and field."""
    joined = F.concat_ws("_", "category", "field")
    return (F.col("field") == name) | (F.col("category").isNotNull() & (joined == name))


def bind_header(header: DataFrame, wanted: Sequence[Column]) -> DataFrame:
    """Per (file, sheet): for each wanted column how often it occurs and where it is.

    The file stem is worked out here as well, once per file instead of once per row.
    """
    found = [F.count_if(test).alias(f"n{i}") for i, test in enumerate(wanted)]
    places = [F.max(F.when(test, F.col("col_idx"))).alias(f"x{i}") for i, test in enumerate(wanted)]
    filled = F.sort_array(F.collect_set(F.when(F.col("col_idx") >= 0, F.col("col_idx"))))
    return (
        header.groupBy(*FILE_KEY)
        .agg(*found, *places, filled.alias("named_idx"))
        .withColumn("stem", file_stem(F.col("source_file")))
    )


def rule_matches(rules: DataFrame, header: DataFrame) -> DataFrame:
    """Rules of a whole catalog with the number of files where they meet one column, or several.

    Headers shrink to one row per name before the join, so neither files nor rules multiply.
    """
    per_file = header.groupBy(*FILE_KEY, "category", "field").agg(F.count("*").alias("n"))
    names = per_file.groupBy(
        F.col("category").alias("head_category"), F.col("field").alias("head_field")
    ).agg(
        F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("several")
    )
    same = (F.col("field") == F.col("head_field")) & F.col("category").eqNullSafe(
        F.col("head_category")
    )
    return rules.join(names, same, "left").select(
        *rules.columns,
        F.coalesce("single", F.lit(0)).alias("files_matched"),
        F.coalesce("several", F.lit(0)).alias("files_ambiguous"),
    )


def callable_names(header: DataFrame) -> DataFrame:
    """Names conditions may use per file; more than one column makes a name ambiguous."""
    joined = F.when(
        F.col("category").isNotNull(), F.concat_ws("_", F.col("category"), F.col("field"))
    )
    names = F.array_compact(F.array(F.col("field"), joined))
    return (
        header.select(*FILE_KEY, F.explode(names).alias("name"))
        .groupBy(*FILE_KEY, "name")
        .agg(F.count("*").alias("columns"))
    )


def not_blank(cells: Column, positions: Column) -> Column:
    """True if any named cell of a row holds anything; white space counts as something."""
    def full(position: Column) -> Column:
        text = clean_cell(F.try_element_at(cells, position + 1))
        return F.coalesce(text != "", F.lit(False))

    return F.exists(positions, full)


def sheet_input(
    grid: DataFrame, spec: SheetSpec, rules: Sequence[Rule], inventory: DataFrame | None = None
) -> SheetInput:
    """A logical sheet of every file of ``grid`` as named columns for the rollup.

    Files where a required column is missing or ambiguous become problems of the input; their rows
    add nothing. Files of the ``inventory`` without rows are problems as well.
    """
    rows = named_sheet(grid, spec)
    header = resolve_header(rows, spec)
    if spec.sheet == DEFAULT_SHEET:
        header = header.join(single_sheet_files(grid), "source_file", "left_semi")
    mine = [rule for rule in rules if rule.applies_to(spec.sheet)]
    columns = list(dict.fromkeys((rule.category, rule.field) for rule in mine))
    names: dict[str, list[Rule]] = {}
    for rule in mine:
        for name in _names_of(rule):
            names.setdefault(name, []).append(rule)
    wanted = [matches(*place) for place in columns] + [called(name) for name in names]
    bound = bind_header(header, wanted)
    if spec.last_row < -1:
        bound = bound.join(sheet_totals(rows), FILE_KEY)
    # One row per file: the rows of the grid meet it without being shuffled while it is small.
    bound = lookup_side(bound)
    joined = rows.where(F.col("row_no") > spec.anchor_row).join(bound, FILE_KEY)
    if spec.last_row < -1:
        joined = joined.where(F.col("row_no") <= F.col("total_rows") + spec.last_row + 1)
    elif spec.last_row > 0:
        joined = joined.where(F.col("row_no") <= spec.last_row)
    joined = joined.where(not_blank(F.col("cells"), F.col("named_idx")))

    def value(i: int) -> Column:
        place = F.when(F.col(f"n{i}") == 1, F.col(f"x{i}"))
        return cell_at(place, F.col("cells"), F.col("stem"))

    offset = len(columns)
    frame = joined.select(
        F.col("source_file").alias("__file"),
        F.col("row_no").alias("__row"),
        *[value(i).alias(f"__v{i}") for i in range(offset)],
        *[(F.col(f"n{i}") == 1).alias(f"__p{i}") for i in range(offset)],
        *[value(offset + i).alias(name) for i, name in enumerate(names)],
    )
    place_of = {place: i for i, place in enumerate(columns)}

    def by_column(category: str | None, field: str) -> list[Source]:
        i = place_of[(category, field)]
        return [Source(F.col(f"__v{i}"), T.StringType(), F.col(f"__p{i}"))]

    def by_name(name: str) -> list[Source]:
        return [Source(named(name), T.StringType())] if name in names else []

    return SheetInput(
        frame=frame,
        by_column=by_column,
        by_name=by_name,
        source_file=F.col("__file"),
        row_no=F.col("__row"),
        problems=_problems(grid, bound, spec, mine, place_of, names, inventory),
    )


def _names_of(rule: Rule) -> list[str]:
    try:
        return referenced_names(rule.condition)
    except ConditionError:
        return []  # reported when the rule is bound


def _problems(
    grid: DataFrame,
    bound: DataFrame,
    spec: SheetSpec,
    rules: Sequence[Rule],
    place_of: dict[tuple[str | None, str], int],
    names: dict[str, list[Rule]],
    inventory: DataFrame | None,
) -> DataFrame:
    sheet = F.lit(spec.sheet)
    none = F.lit(None)
    ranges = sheet_bounds(grid, spec, inventory).where(F.col("message").isNotNull())
    if spec.optional:
        ranges = ranges.where(F.col("message") != MISSING_SHEET)
    found = ranges.select(
        "source_file",
        sheet.alias("sheet"),
        none.cast("bigint").alias("row_no"),
        none.cast("string").alias("field"),
        "message",
    )
    notes: list[Column] = []
    for rule in rules:
        count = F.col(f"n{place_of[(rule.category, rule.field)]}")
        text = F.when(count > 1, F.lit(SHARED_FIELD))
        if not rule.optional:
            text = text.when(count == 0, F.lit(MISSING_FIELD))
        notes.append(_note(text, rule.field))
    for i, name in enumerate(names):
        text = F.when(F.col(f"n{len(place_of) + i}") != 1, F.lit(CODE_UNRESOLVED))
        notes.append(_note(text, name))
    if not notes:
        return found
    columns = (
        bound.select("source_file", F.explode(F.array(*notes)).alias("note"))
        .where("note.message is not null")
        .select(
            "source_file",
            sheet.alias("sheet"),
            none.cast("bigint").alias("row_no"),
            "note.field",
            "note.message",
        )
    )
    return found.unionByName(columns)


def _note(message: Column, field: str) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"))


