"""Bill grids: every 50 orders are the workbook of one shop, with a layout of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.rollup import plan_rollup
from ledgerspark.plans.rules import Rule, RuleBundle, SheetSpec
from ledgerspark.plans.validate import field_checks, sheet_checks
from ledgerspark.registry.base import as_double, money_text, query, table
from ledgerspark.session import scratch_path, settings, settle, store
from ledgerspark.sources import files, grid as G

PERIOD = "199904"

# Layouts by shop number modulo 4: plain, moved columns, a doubled column, a missing column.
_ORDER = ["order", "amount", "fee", "date", "status"]
_MOVED = ["date", "order", "status", "amount", "fee"]
_DOUBLED = [*_ORDER, "amount"]
_SHORT = ["order", "amount", "date", "status"]
LAYOUTS = [_ORDER, _MOVED, _DOUBLED, _SHORT]
UPPER = {"order": None, "amount": "Money", "fee": "Money", "date": " When ", "status": "status"}


def _sql_cells(values: dict[str, str]) -> str:
    """DuckDB list of one row for all layouts."""
    rows = [
        f"WHEN {i} THEN [{', '.join(values[name] for name in layout)}]"
        for i, layout in enumerate(LAYOUTS)
    ]
    return f"CASE shop % 4 {' '.join(rows)} END"


_UPPER_SQL = {n: "CAST(NULL AS VARCHAR)" if u is None else f"'{u}'" for n, u in UPPER.items()}
_NAME_SQL = {n: f"' {n}'" for n in UPPER}
_BODY_SQL = {
    "order": "'``' || o_orderkey",
    "amount": "CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 9 = 0 THEN '`' || amt ELSE amt END",
    "fee": "CASE WHEN o_orderkey % 8 = 0 THEN '-' ELSE CAST(o_custkey % 100 AS VARCHAR) END",
    "date": "strftime(o_orderdate, '%Y-%m-%d')",
    "status": "o_orderstatus",
}
_EMPTY_SQL = {n: "''" for n in UPPER}

GRID_SQL = f"""
    bills AS (SELECT *, o_orderkey // 50 AS shop,
                     CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amt FROM orders),
    shops AS (SELECT DISTINCT shop FROM bills),
    grid AS (
        SELECT 'bills/shop-' || shop || '.xlsx' AS source_file, 'orders' AS sheet, 1 AS row_no,
               ['Report', CAST(shop AS VARCHAR)] AS cells, shop FROM shops
        UNION ALL
        SELECT 'bills/shop-' || shop || '.xlsx', 'orders', 2, {_sql_cells(_UPPER_SQL)}, shop FROM shops
        UNION ALL
        SELECT 'bills/shop-' || shop || '.xlsx', 'orders', 3, {_sql_cells(_NAME_SQL)}, shop FROM shops
        UNION ALL
        SELECT 'bills/shop-' || shop || '.xlsx', 'orders', o_orderkey % 50 + 4,
               CASE WHEN o_orderkey % 23 = 0 THEN {_sql_cells(_EMPTY_SQL)}
                    ELSE {_sql_cells(_BODY_SQL)} END, shop FROM bills
        UNION ALL
        SELECT 'bills/shop-' || shop || '.xlsx', 'notes', 1, ['note'], shop FROM shops WHERE shop % 3 = 0)
"""


def _cells(values: dict[str, Column]) -> Column:
    chosen = None
    for i, layout in enumerate(LAYOUTS):
        row = F.array(*[values[name] for name in layout])
        test = F.col("shop") % 4 == i
        chosen = F.when(test, row) if chosen is None else chosen.when(test, row)
    return chosen


def bill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid of all shops: a title row, two header rows and one row per order."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    bills = orders.withColumn("shop", F.floor(key / 50))
    shops = bills.select("shop").distinct()
    amount = money_text("o_totalprice")
    tick = F.lit("`")
    body = {
        "order": F.concat(F.lit("``"), key.cast("string")),
        "amount": F.when(key % 31 == 0, F.lit(""))
        .when(key % 9 == 0, F.concat(tick, amount))
        .otherwise(amount),
        "fee": F.when(key % 8 == 0, F.lit("-")).otherwise(
            (F.col("o_custkey") % 100).cast("string")
        ),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "status": F.col("o_orderstatus"),
    }
    upper = {name: F.lit(text).cast("string") for name, text in UPPER.items()}
    lower = {name: F.lit(f" {name}") for name in UPPER}
    empty = {name: F.lit("") for name in UPPER}

    def rows(frame: DataFrame, sheet: str, row_no: Column | int, cells: Column) -> DataFrame:
        number = F.lit(row_no) if isinstance(row_no, int) else row_no
        return frame.select(
            F.format_string("bills/shop-%d.xlsx", "shop").alias("source_file"),
            F.lit(sheet).alias("sheet"),
            number.cast("bigint").alias("row_no"),
            cells.alias("cells"),
        )

    title = F.array(F.lit("Report"), F.col("shop").cast("string"))
    line = F.when(key % 23 == 0, _cells(empty)).otherwise(_cells(body))
    return (
        rows(shops, "orders", 1, title)
        .unionByName(rows(shops, "orders", 2, _cells(upper)))
        .unionByName(rows(shops, "orders", 3, _cells(lower)))
        .unionByName(rows(bills, "orders", key % 50 + 4, line))
        .unionByName(rows(shops.where("shop % 3 = 0"), "notes", 1, F.array(F.lit("note"))))
    )


ONE_LEVEL = SheetSpec("orders", field_row=3)
TWO_LEVEL = SheetSpec("orders", field_row=3, category_row=2)

_HEADER_SQL = f"""
    {GRID_SQL},
    pairs AS (
        SELECT source_file, sheet, i - 1 AS col_idx,
               nullif(trim(max(CASE WHEN row_no = 3 THEN cells[i] END)), '') AS here,
               nullif(trim(max(CASE WHEN row_no = 2 THEN cells[i] END)), '') AS above
        FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM grid
              WHERE sheet = 'orders' AND row_no IN (2, 3)) GROUP BY 1, 2, 3),
    header1 AS (
        SELECT source_file, sheet, col_idx, CAST(NULL AS VARCHAR) AS category, here AS field
        FROM pairs WHERE here IS NOT NULL
        UNION ALL SELECT DISTINCT source_file, 'orders', -1, NULL, 'FILE_NAME' FROM grid),
    header2 AS (
        SELECT source_file, sheet, col_idx, CASE WHEN here = above THEN NULL ELSE above END AS category,
               here AS field FROM pairs WHERE here IS NOT NULL
        UNION ALL SELECT DISTINCT source_file, 'orders', -1, NULL, 'FILE_NAME' FROM grid),
    long1 AS (
        SELECT g.source_file, g.row_no, h.col_idx, h.field,
               CASE WHEN h.col_idx = -1 THEN 'shop-' || g.shop
                    ELSE ltrim(g.cells[h.col_idx + 1], '`') END AS value
        FROM grid g JOIN header1 h ON g.source_file = h.source_file AND g.sheet = 'orders'
        WHERE g.row_no > 3)
"""


@query(f"WITH {_HEADER_SQL} SELECT source_file, col_idx, category, field FROM header1")
def header_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column descriptors from one header row, with the virtual file name."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), ONE_LEVEL)
    return G.resolve_header(rows, ONE_LEVEL).drop("sheet")


@query(f"WITH {_HEADER_SQL} SELECT source_file, col_idx, category, field FROM header2")
def header_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column descriptors from a category row and a field row."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), TWO_LEVEL)
    return G.resolve_header(rows, TWO_LEVEL).drop("sheet")


@query(
    f"""WITH {_HEADER_SQL}
    SELECT source_file, coalesce(category, '') AS category, field, count(*) AS occurrences
    FROM header2 GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def header_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names that occur more than once in a file."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), TWO_LEVEL)
    return G.duplicate_headers(G.resolve_header(rows, TWO_LEVEL)).drop("sheet")


@query(
    f"""WITH {_HEADER_SQL}
    SELECT l.source_file, l.row_no, l.col_idx, l.field, l.value FROM long1 l
    JOIN (SELECT source_file, row_no FROM long1 WHERE col_idx >= 0 GROUP BY 1, 2
          HAVING count(*) FILTER (WHERE coalesce(value, '') <> '') > 0) USING (source_file, row_no)"""
)
def data_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named cells of all data rows: back-ticks removed, blank rows dropped, file name added."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), ONE_LEVEL)
    header = G.resolve_header(rows, ONE_LEVEL)
    bound = G.bind_header(header, []).select(*G.FILE_KEY, "named_idx")
    data = G.data_rows(rows, ONE_LEVEL).join(bound, G.FILE_KEY)
    data = data.where(G.not_blank(F.col("cells"), F.col("named_idx"))).drop("named_idx")
    return G.long_cells(data, header).drop("sheet", "category")


# A range spec per shop class: end of sheet, one row off, four rows off, fixed, zero, too late.
_SPECS = [-1, -2, -4, 30, 0, 99, 3]


def _range_sql(last: int) -> str:
    resolved = f"total_rows + {last} + 1" if last < 0 else str(last)
    return f"""
        SELECT {last} AS last_row, source_file, total_rows, {resolved} AS resolved_last_row,
               CASE WHEN {last} = 0 THEN 'last_row cannot be zero.'
                    WHEN {resolved} < 1 THEN 'field_row and last_row must resolve to positive row numbers.'
                    WHEN 3 > total_rows THEN 'field_row exceeds the actual file row count.'
                    WHEN {resolved} > total_rows THEN 'last_row exceeds the actual file row count.'
                    WHEN 4 > {resolved} AND NOT ({last} = -1 AND total_rows = 3)
                    THEN 'The data range is empty after applying category_row, field_row, and last_row.'
               END AS message FROM totals"""


@query(
    f"WITH {GRID_SQL}, totals AS (SELECT source_file, count(*) AS total_rows FROM grid"
    " WHERE sheet = 'orders' GROUP BY 1) " + " UNION ALL ".join(_range_sql(n) for n in _SPECS)
)
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved last rows and range errors of every file under several range settings."""
    rows = settle(bill_grid(spark, sf_dir).select(*G.FILE_KEY))
    parts = []
    for last in _SPECS:
        spec = SheetSpec("orders", field_row=3, last_row=last)
        bounds = G.sheet_bounds(rows, spec).withColumn("last_row", F.lit(last))
        parts.append(
            bounds.select(
                "last_row", "source_file", "total_rows", "resolved_last_row", "message"
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    f"""WITH {GRID_SQL}, totals AS (
        SELECT source_file, count(*) AS total_rows FROM grid WHERE sheet = 'orders' GROUP BY 1)
    SELECT source_file, row_no FROM grid JOIN totals USING (source_file)
    WHERE sheet = 'orders' AND row_no > 3 AND row_no <= total_rows - 3"""
)
def rows_before_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows with the last three rows of every sheet left out."""
    spec = SheetSpec("orders", field_row=3, last_row=-4)
    rows = G.pick_sheet(bill_grid(spark, sf_dir), spec)
    return G.data_rows(rows, spec).select("source_file", "row_no")


@query(
    f"""WITH {GRID_SQL}, sheets AS (
        SELECT source_file, count(DISTINCT sheet) AS n, max(shop) AS shop FROM grid GROUP BY 1)
    SELECT source_file, CASE WHEN n > 1
        THEN 'DEFAULT logical sheet can only be used when the workbook has exactly one sheet.' END AS message
    FROM sheets"""
)
def default_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEFAULT stands for the only sheet of a workbook and is refused where there are two."""
    bounds = G.sheet_bounds(bill_grid(spark, sf_dir), SheetSpec("DEFAULT", field_row=3))
    return bounds.select("source_file", "message")


_MERGED_SQL = """
    cells AS (SELECT 'shop-' || (o_orderkey // 50) AS source_file, 'orders' AS sheet,
                     o_orderkey % 50 + 1 AS row_no, c AS col_no,
                     CASE c WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority
                            ELSE CAST(o_custkey AS VARCHAR) END AS value
              FROM orders, range(1, 4) t(c)),
    ranges AS (SELECT 'shop-' || (o_orderkey // 50) AS source_file, 'orders' AS sheet,
                      o_orderkey % 50 + 1 AS min_row, o_orderkey % 50 + 2 AS max_row,
                      2 AS min_col, 4 AS max_col FROM orders WHERE o_orderkey % 10 = 3)
"""


@query(
    f"""WITH {_MERGED_SQL},
    covered AS (
        SELECT r.source_file, r.sheet, a AS row_no, b AS col_no, k.value AS corner
        FROM ranges r JOIN cells k ON k.source_file = r.source_file AND k.row_no = r.min_row
             AND k.col_no = r.min_col, range(0, 2) x(i), range(0, 3) y(j), LATERAL (SELECT r.min_row + i AS a, r.min_col + j AS b))
    SELECT coalesce(c.source_file, v.source_file) AS source_file, coalesce(c.row_no, v.row_no) AS row_no,
           coalesce(c.col_no, v.col_no) AS col_no,
           CASE WHEN v.source_file IS NOT NULL THEN v.corner ELSE c.value END AS value
    FROM cells c FULL JOIN covered v
      ON c.source_file = v.source_file AND c.row_no = v.row_no AND c.col_no = v.col_no"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cells: every coordinate of a range takes the value of its top-left cell."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("shop-"), F.floor(key / 50).cast("string")).alias("source_file"),
        F.lit("orders").alias("sheet"),
        (key % 50 + 1).alias("row_no"),
        "o_orderkey",
        F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("all"),
    )
    cells = orders.select(*G.FILE_KEY, "row_no", F.posexplode("all").alias("at", "value")).select(
        *G.FILE_KEY, "row_no", (F.col("at") + 1).alias("col_no"), "value"
    )
    ranges = orders.where(key % 10 == 3).select(
        *G.FILE_KEY,
        F.col("row_no").alias("min_row"),
        (F.col("row_no") + 1).alias("max_row"),
        F.lit(2).alias("min_col"),
        F.lit(4).alias("max_col"),
    )
    return G.expand_merged(cells, ranges).drop("sheet")


@query(
    """
    SELECT 'shop-' || (o_orderkey // 50) AS source_file, o_orderkey % 50 + 1 AS row_no,
           CASE WHEN o_orderkey % 35 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS width,
           o_orderstatus || CASE WHEN o_orderkey % 35 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '|?'
                                 ELSE '|' || o_orderpriority END ||
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '|' || o_custkey END AS shown
    FROM orders"""
)
def grid_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of single cells put together to grid rows; cells nobody wrote are NULL."""
    key = F.col("o_orderkey")
    cells = (
        table(spark, sf_dir, "orders")
        .select(
            F.concat(F.lit("shop-"), F.floor(key / 50).cast("string")).alias("source_file"),
            F.lit("orders").alias("sheet"),
            (key % 50 + 1).alias("row_no"),
            "o_orderkey",
            F.posexplode(
                F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
            ).alias("at", "value"),
        )
        .where(~((key % 5 == 0) & (F.col("at") == 2)) & ~((key % 7 == 0) & (F.col("at") == 1)))
        .withColumn("col_no", F.col("at") + 1)
    )
    made = G.grid_from_cells(cells)
    shown = F.array_join("cells", "|", "?")
    return made.select(
        "source_file", "row_no", F.size("cells").alias("width"), shown.alias("shown")
    )


_ROWS_SQL = f"""
    {GRID_SQL},
    lines AS (
        SELECT source_file, shop, row_no, o.*,
               CASE WHEN shop % 4 = 3 THEN NULL WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_custkey % 100 END AS fee
        FROM grid g JOIN orders o ON o.o_orderkey = g.shop * 50 + g.row_no - 4
        WHERE g.sheet = 'orders' AND g.row_no > 3 AND o_orderkey % 23 <> 0)
"""


@query(
    f"""WITH {_ROWS_SQL}
    SELECT '199904' AS period, 'shop-' || shop AS source, o_orderstatus AS status,
           CAST(COALESCE(SUM(fee), 0) AS DOUBLE) AS fees,
           CAST(COALESCE(SUM(o_orderkey) FILTER (WHERE strftime(o_orderdate, '%Y%m') = '199904'), 0) AS DOUBLE)
               AS keys_in_period
    FROM lines GROUP BY 2, 3"""
)
def grid_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup of all workbooks, whatever place a column has in each of them."""
    rules = (
        Rule("source", "GROUP", "orders", "FILE_NAME"),
        Rule("status", "GROUP", "orders", "status"),
        Rule("fees", "SUM", "orders", "fee", category="Money", optional=True),
        Rule(
            "keys_in_period",
            "SUM",
            "orders",
            "order",
            condition=lambda f: f.period_of(f("When_date")) == f.current_period,
        ),
    )
    bundle = RuleBundle("bills", (TWO_LEVEL,), rules)
    grid = store(bill_grid(spark, sf_dir))
    plan = plan_rollup({"orders": G.sheet_input(grid, TWO_LEVEL, rules)}, bundle, PERIOD)
    return as_double(plan.release(), "fees", "keys_in_period")


@query(
    f"""WITH {_ROWS_SQL}
    SELECT source_file, CAST(row_no AS BIGINT) AS row_no, 'amount' AS field,
           'SUM field ''amount'' is empty.' AS message
    FROM lines WHERE shop % 4 <> 2 AND o_orderkey % 31 = 0
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', NULL, 'amount',
           'The field mapping is duplicated in the source file.' FROM shops WHERE shop % 4 = 2
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', NULL, 'fee', 'Required field is missing.'
    FROM shops WHERE shop % 4 = 3
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', NULL, NULL, 'Required sheet is missing.'
    FROM shops WHERE shop % 3 <> 0"""
)
def grid_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of files and rows: missing sheets, missing or doubled columns, empty amounts."""
    notes = SheetSpec("notes")
    rules = (
        Rule("source", "GROUP", "orders", "FILE_NAME"),
        Rule("amount", "SUM", "orders", "amount", category="Money"),
        Rule("fees", "SUM", "orders", "fee", category="Money"),
    )
    bundle = RuleBundle("bills", (TWO_LEVEL, notes), rules)
    grid = store(bill_grid(spark, sf_dir))
    inputs = {spec.sheet: G.sheet_input(grid, spec, rules) for spec in bundle.sheets}
    return plan_rollup(inputs, bundle, PERIOD).issues().drop("sheet")


@query(
    f"""WITH {GRID_SQL}
    SELECT 'bills/shop-' || shop || '.xlsx' AS source_file, unnest(['sheet_exists', 'data_range']) AS check_name,
           'sheet:orders' AS scope, TRUE AS passed,
           unnest(['Sheet exists.', 'The configured data range is valid.']) AS message FROM shops
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'sheet_exists', 'sheet:notes', FALSE, 'Required sheet is missing.'
    FROM shops WHERE shop % 3 <> 0
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'data_range', 'sheet:notes', FALSE,
           'The data range cannot be validated because the required sheet is missing.'
    FROM shops WHERE shop % 3 <> 0
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'sheet_exists', 'sheet:notes', TRUE, 'Sheet exists.'
    FROM shops WHERE shop % 3 = 0
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'data_range', 'sheet:notes', TRUE, 'The configured data range is valid.'
    FROM shops WHERE shop % 3 = 0
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'sheet_exists', 'sheet:extra', TRUE, 'Optional sheet is missing.'
    FROM shops
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'data_range', 'sheet:orders', FALSE,
           'last_row exceeds the actual file row count.' FROM shops"""
)
def check_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet and range checks of every workbook."""
    grid = settle(bill_grid(spark, sf_dir).select(*G.FILE_KEY))
    specs = [
        TWO_LEVEL,
        SheetSpec("notes"),
        SheetSpec("extra", optional=True),
        SheetSpec("orders", field_row=3, last_row=99),
    ]
    report = sheet_checks(grid, specs[0])
    for spec in specs[1:]:
        report = report.unionByName(sheet_checks(grid, spec))
    return report.select(
        F.col("details")["source_file"].alias("source_file"),
        "check_name",
        "scope",
        "passed",
        "message",
    )


@query(
    f"""WITH {GRID_SQL}
    SELECT 'bills/shop-' || shop || '.xlsx' AS source_file, 'field_exists' AS check_name, 'rule:amount' AS scope,
           shop % 4 <> 2 AS passed,
           CASE WHEN shop % 4 = 2 THEN 'The field mapping is duplicated in the sampled source file.'
                ELSE 'Field exists.' END AS message,
           CASE WHEN shop % 4 = 1 THEN '4' WHEN shop % 4 <> 2 THEN '2' END AS matched, NULL AS code FROM shops
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'field_exists', 'rule:fee', shop % 4 <> 3,
           CASE WHEN shop % 4 = 3 THEN 'Required field is missing.' ELSE 'Field exists.' END,
           CASE WHEN shop % 4 = 1 THEN '5' WHEN shop % 4 <> 3 THEN '3' END, NULL FROM shops
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'field_exists', 'rule:rebate', TRUE, 'Optional field is missing.',
           NULL, NULL FROM shops
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'condition_valid', 'rule:amount', TRUE,
           'Condition can be evaluated.', NULL, NULL FROM shops WHERE shop % 4 <> 2
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'condition_valid', 'rule:fee', FALSE,
           'the condition names an unknown field: nothing', NULL, 'condition_identifier_unresolved'
    FROM shops WHERE shop % 4 <> 3
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'field_exists', 'rule:' || r, TRUE, 'Field exists.',
           CASE WHEN shop % 4 = 1 THEN '3' WHEN shop % 4 = 0 THEN '5' WHEN shop % 4 = 2 THEN '5' ELSE '4' END, NULL
    FROM shops, (VALUES ('unfinished'), ('broken'), ('foreign')) t(r)
    UNION ALL
    SELECT 'bills/shop-' || shop || '.xlsx', 'condition_valid', 'rule:' || r, FALSE, m, NULL, c
    FROM shops, (VALUES
        ('unfinished', 'the condition is still a placeholder', 'condition_placeholder_detected'),
        ('broken', 'the condition is not a valid expression', 'condition_parse_failed'),
        ('foreign', 'the condition calls an unknown function', 'condition_function_not_allowed')) t(r, m, c)"""
)
def check_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and condition checks of every workbook for every rule."""
    from ledgerspark.functions.conditions import install_sql_helpers

    install_sql_helpers(spark)
    rules = (
        Rule("amount", "SUM", "orders", "amount", "Money", "period_of(`date`) = current_period"),
        Rule("fee", "SUM", "orders", "fee", "Money", "`nothing` = 'x'"),
        Rule("rebate", "SUM", "orders", "rebate", optional=True),
        Rule("unfinished", "SUM", "orders", "status", None, "CONDITION"),
        Rule("broken", "SUM", "orders", "status", None, "`status` = = 'x'"),
        Rule("foreign", "SUM", "orders", "status", None, "no_such_function(`status`) = 'x'"),
    )
    grid = store(bill_grid(spark, sf_dir))
    report = field_checks(grid, TWO_LEVEL, rules)
    return report.select(
        F.col("details")["source_file"].alias("source_file"),
        "check_name",
        "scope",
        "passed",
        "message",
        F.col("details")["matched_column"].alias("matched"),
        F.col("details")["code"].alias("code"),
    )


def _rules_sql() -> str:
    return """
    rules AS (SELECT p_partkey AS rule_no, CASE WHEN p_partkey % 3 = 0 THEN 'amount' WHEN p_partkey % 3 = 1
                     THEN 'status' ELSE 'none' END AS field,
                     CASE WHEN p_partkey % 2 = 0 THEN 'Money' END AS category FROM part)"""


@query(
    f"""WITH {_HEADER_SQL}, {_rules_sql()},
    per_file AS (SELECT source_file, category, field, count(*) AS n FROM header2 GROUP BY 1, 2, 3),
    names AS (SELECT category, field, count(*) FILTER (WHERE n = 1) AS single,
                     count(*) FILTER (WHERE n > 1) AS several FROM per_file GROUP BY 1, 2)
    SELECT rule_no, coalesce(single, 0) AS files_matched, coalesce(several, 0) AS files_ambiguous
    FROM rules r LEFT JOIN names n ON n.field = r.field AND n.category IS NOT DISTINCT FROM r.category"""
)
def rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many files each rule of a catalog meets one column, and in how many several."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), TWO_LEVEL)
    header = G.resolve_header(rows, TWO_LEVEL)
    key = F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(
        key.alias("rule_no"),
        F.when(key % 3 == 0, F.lit("amount"))
        .when(key % 3 == 1, F.lit("status"))
        .otherwise(F.lit("none"))
        .alias("field"),
        F.when(key % 2 == 0, F.lit("Money")).alias("category"),
    )
    return G.rule_matches(rules, header).select("rule_no", "files_matched", "files_ambiguous")


@query(
    f"""WITH {_HEADER_SQL},
    names AS (
        SELECT source_file, field AS name FROM header2
        UNION ALL SELECT source_file, category || '_' || field FROM header2 WHERE category IS NOT NULL)
    SELECT source_file, name, count(*) AS columns FROM names GROUP BY 1, 2"""
)
def condition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names a condition may use in each file, with the number of columns they stand for."""
    rows = G.pick_sheet(bill_grid(spark, sf_dir), TWO_LEVEL)
    return G.callable_names(G.resolve_header(rows, TWO_LEVEL)).drop("sheet")


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
           'say "hi", ' || o_orderstatus || chr(10) || 'next' AS note FROM orders"""
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with quotes, line breaks and blank rows, written and read back as a grid."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    lines = orders.select(
        key.cast("string").alias("a"),
        money_text("o_totalprice").alias("b"),
        F.concat(F.lit('say "hi", '), "o_orderstatus", F.lit("\nnext")).alias("c"),
    )
    blanks = orders.where(key % 10 == 3).select(
        F.lit(" ").alias("a"), F.lit("").alias("b"), F.lit("  ").alias("c")
    )
    path = scratch_path(spark, "bills")
    lines.unionByName(blanks).write.option("escape", '"').csv(path)
    grid = files.read_grid(spark, path)
    return grid.select(
        F.col("cells")[0].alias("order_key"),
        F.col("cells")[1].alias("amount"),
        F.col("cells")[2].alias("note"),
    )


@query("SELECT 8 AS files, count(*) AS rows, count(*) AS exact FROM orders")
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of CSV files are the places at which the writing tasks put the rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "numbered")
    # One task writes one file; the lower 33 bits of the id count the rows of a task from 0.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    orders.repartition(8, "o_orderkey").sortWithinPartitions("o_orderkey").select(
        "o_orderkey", "o_orderstatus", place
    ).write.csv(path)
    grid = files.read_grid(spark, path)
    return grid.agg(
        F.countDistinct("source_file").alias("files"),
        F.count("*").alias("rows"),
        F.count_if(F.col("row_no") == F.col("cells")[2].cast("bigint")).alias("exact"),
    )


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key, 1 + o_orderkey % 6 AS width,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS last_cell, CAST(greatest(o_orderkey % 6 - 1, 0) AS BIGINT) AS gaps
    FROM orders"""
)
def csv_unequal_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one to six cells, empty ones before the last: every row has the cells of its record."""
    key = F.col("o_orderkey")
    gap = F.repeat(F.lit(","), (key % 6).cast("int"))
    last = F.when(key % 6 == 0, F.lit("")).otherwise(F.col("o_orderstatus"))
    path = scratch_path(spark, "bills")
    lines = table(spark, sf_dir, "orders").select(F.concat(key.cast("string"), gap, last), (key % 3).alias("part"))
    # Written as one column with another separator, so widths are what the lines say.
    lines.write.partitionBy("part").option("sep", "\u0001").csv(path)
    grid = files.read_grid(spark, path)
    cells = F.col("cells")
    return grid.select(
        cells[0].alias("order_key"), F.size(cells).cast("long").alias("width"),
        F.when(F.size(cells) > 1, F.element_at(cells, -1)).alias("last_cell"),
        F.size(F.filter(cells, lambda c: c == "")).cast("long").alias("gaps"),
    )


# Small files are cut into many blocks too; large ones into a few hundred, as every block is a task.
LEAST_BLOCK, BLOCKS = 16 << 10, 256


def block_bytes(length: int) -> int:
    """Bytes of the blocks in which a file of this length is read."""
    return max(LEAST_BLOCK, -(-length // BLOCKS))


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key, row_number() OVER (ORDER BY o_orderkey) AS row_no,
        CASE o_orderkey % 4 WHEN 0 THEN 'two' || chr(10) || 'lines, ' || o_orderstatus WHEN 1 THEN '"' || o_orderstatus || '"' || chr(10)
            WHEN 2 THEN 'in"side' ELSE repeat('long' || chr(10), 40) END AS note
    FROM orders"""
)
def csv_quoted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of records with line breaks, read in many blocks that cut them anywhere."""
    key = F.col("o_orderkey")
    note = (
        F.when(key % 4 == 0, F.concat(F.lit("two\nlines, "), "o_orderstatus"))
        .when(key % 4 == 1, F.concat(F.lit('"'), "o_orderstatus", F.lit('"\n')))
        .when(key % 4 == 2, F.lit('in"side'))
        .otherwise(F.repeat(F.lit("long\n"), 40))
    )
    path = scratch_path(spark, "bills")
    # Sorted by many tasks; one task only writes.
    ordered = settle(table(spark, sf_dir, "orders").select(key.alias("key"), note.alias("note")).orderBy("key"))
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ordered.coalesce(1).write.options(**options).csv(path)
    length = files.file_inventory(spark, path).agg(F.sum("length")).first()[0] or 0
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(block_bytes(length)), "spark.sql.files.openCostInBytes": "0"}):
        grid = store(files.read_grid(spark, path), "grid")
    return grid.select(F.col("cells")[0].alias("order_key"), "row_no", F.col("cells")[1].alias("note"))


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key, '门店单据 ' || o_orderkey AS note,
        CASE WHEN o_orderkey % 2 = 0 THEN 'UTF-8' ELSE 'GB18030' END AS encoding
    FROM orders"""
)
def csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file is read in the encoding that its bytes fit, whatever its folder is called."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(
        key.cast("string"), F.concat(F.lit("门店单据 "), key.cast("string")), (key % 2 == 0).alias("even")
    )
    path = scratch_path(spark, "bills")
    for even, encoding, folder in ((True, files.UTF8, "门店 1"), (False, files.GB18030, "门店+2")):
        part = lines.where(F.col("even") == even).drop("even")
        part.write.option("encoding", encoding).csv(f"{path}/{folder}")
    judged = files.file_encodings(spark, path).select(F.col("path").alias("source_file"), "encoding")
    grid = files.read_grid(spark, path, numbered=False)
    return grid.join(judged, "source_file").select(
        F.col("cells")[0].alias("order_key"), F.col("cells")[1].alias("note"), "encoding"
    )


@query(
    """
    SELECT 'bills/' || p_brand || '/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xlsx'
               WHEN 2 THEN '.xlsm' ELSE '.csv' END AS path
    FROM part WHERE p_partkey % 5 <> 3 AND p_partkey % 7 <> 0"""
)
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listed files are read: known types, temporary files left out."""
    key = F.col("p_partkey")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".CSV", ".xlsx", ".xlsm", ".pdf", ".csv")]),
        (key % 5 + 1).cast("int"),
    )
    mark = F.when(key % 7 == 0, F.lit("~$")).otherwise(F.lit(""))
    listed = table(spark, sf_dir, "part").select(
        F.concat(F.lit("bills/"), "p_brand", F.lit("/"), mark, key.cast("string"), suffix).alias(
            "path"
        )
    )
    return files.supported_files(listed).select("path")


@query(
    """
    WITH listed AS (SELECT 'bills/' || p_brand || '/' || p_partkey || '.csv' AS path FROM part)
    SELECT seed, arg_min(path, sha256(seed || path)) AS path
    FROM listed, (VALUES ('preview'), ('check'), ('')) AS seeds(seed) GROUP BY seed"""
)
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative file of a listing, for three seeds."""
    listed = files.supported_files(
        table(spark, sf_dir, "part").select(
            F.concat(F.lit("bills/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias(
                "path"
            )
        )
    )
    picks = [
        files.sample_file(listed, seed).select(F.lit(seed).alias("seed"), "path") for seed in ("preview", "check", "")
    ]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@query(
    """
    SELECT CASE o_orderkey % 3 WHEN 0 THEN '_first' WHEN 1 THEN '.second' ELSE 'third' END AS folder, count(*) AS total_rows,
        CAST(NULL AS VARCHAR) AS message
    FROM orders GROUP BY 1
    UNION ALL SELECT 'empty', 0, 'No rows were found in this file.'"""
)
def files_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose folders Spark's readers leave out, and a file without rows: all are in the report."""
    path = scratch_path(spark, "bills")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for rest, folder in enumerate(("_first", ".second", "third")):
        orders.where(F.col("o_orderkey") % 3 == rest).coalesce(1).write.csv(f"{path}/{folder}")
    orders.where(F.lit(False)).select("o_orderkey").coalesce(1).write.csv(f"{path}/empty")
    inventory = files.file_inventory(spark, path)
    bounds = G.sheet_bounds(files.read_grid(spark, path), SheetSpec("DEFAULT"), inventory)
    place = F.col("source_file")
    return bounds.select(
        F.regexp_extract(place, "/([^/]*)/[^/]*$", 1).alias("folder"), "total_rows",
        F.replace("message", place, F.lit("this file")).alias("message"),
    )


@query(
    """
    WITH cells AS (
        SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n,
            CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size FROM part),
    firsts AS (SELECT * FROM cells WHERE n = 1),
    rules(scope, kind) AS (VALUES ('rule:large', 'number'), ('rule:named', 'text'), ('rule:ordered', 'order'),
        ('rule:lost', 'lost'), ('rule:open', 'placeholder'), ('rule:broken', 'broken'), ('rule:strange', 'call'), ('rule:short', 'skip'))
    SELECT 'bills/' || p_brand || '.csv' AS source_file, scope,
        CASE kind WHEN 'number' THEN CASE WHEN size = 'n/a' THEN 'condition_runtime_error' END
            WHEN 'order' THEN 'condition_runtime_error' WHEN 'lost' THEN 'condition_identifier_unresolved'
            WHEN 'placeholder' THEN 'condition_placeholder_detected' WHEN 'broken' THEN 'condition_parse_failed'
            WHEN 'call' THEN 'condition_function_not_allowed' END AS code
    FROM firsts, rules"""
)
def condition_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's condition tried on the first row of every file: the code of what is wrong, if anything."""
    part = table(spark, sf_dir, "part")
    source = F.concat(F.lit("bills/"), "p_brand", F.lit(".csv"))
    size = F.when(F.col("p_partkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    rows = part.select(
        source.alias("source_file"), F.lit("DEFAULT").alias("sheet"), (F.col("p_partkey") + 2).alias("row_no"),
        F.array(F.col("p_name"), size).alias("cells"),
    )
    heads = part.select(source.alias("source_file")).distinct().select(
        "source_file", F.lit("DEFAULT").alias("sheet"), F.lit(1).cast("bigint").alias("row_no"),
        F.array(F.lit("name"), F.lit("size")).alias("cells"),
    )
    conditions = {
        "large": 'as_number(F("size")) > 10',
        "named": "`name` <> '' and `size` = 5",
        "ordered": 'F("name") > 5',
        "lost": 'F("colour") == "red"',
        "open": "CONDITION",
        "broken": 'F("name") == ',
        "strange": 'open(F("name")) == "x"',
        # The right side is never reached.
        "short": 'F("name") == None and as_number(F("name")) > 1',
    }
    rules = [Rule(name, "SUM", "DEFAULT", "size", condition=text) for name, text in conditions.items()]
    grid = settle(heads.unionByName(rows))
    report = field_checks(grid, SheetSpec("DEFAULT"), rules).where("check_name = 'condition_valid'")
    return report.select(
        F.col("details.source_file").alias("source_file"), "scope", F.col("details.code").alias("code")
    )
