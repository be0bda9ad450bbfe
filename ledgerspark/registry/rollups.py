"""Rule-driven rollups over the order and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import conditions
from ledgerspark.functions.conditions import install_sql_helpers
from ledgerspark.plans import rules as R
from ledgerspark.plans.rollup import plan_rollup, table_input
from ledgerspark.plans.rules import Rule, RuleBundle, SheetSpec
from ledgerspark.registry.base import as_double, money_text, query, table
from ledgerspark.registry.scalars import _ORDERS_SQL, amount_cell

PERIOD = "199904"


def bundle(*rules: Rule, sheets: tuple[str, ...] = ("lines",)) -> RuleBundle:
    return RuleBundle("demo", tuple(SheetSpec(name) for name in sheets), rules)


def group(output: str, field: str, sheet: str = "lines", **more) -> Rule:
    return Rule(output, R.GROUP, sheet, field, **more)


def total(output: str, field: str, sheet: str = "lines", **more) -> Rule:
    return Rule(output, R.SUM, sheet, field, **more)


@query(
    """
    SELECT '199904' AS period, l_returnflag, l_linestatus,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
           CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (WHERE strftime(l_shipdate, '%Y%m') = '199904'), 0) AS DOUBLE) AS price_in_period
    FROM lineitem GROUP BY 2, 3"""
)
def rollup_conditional_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups, a plain sum and a sum of the lines shipped in the period."""
    rules = bundle(
        group("l_returnflag", "l_returnflag"),
        group("l_linestatus", "l_linestatus"),
        total("qty", "l_quantity"),
        total(
            "price_in_period",
            "l_extendedprice",
            condition=lambda f: f.period_of(f("l_shipdate")) == f.current_period,
        ),
    )
    lines = table_input(table(spark, sf_dir, "lineitem"))
    result = plan_rollup({"lines": lines}, rules, PERIOD).release()
    return as_double(result, "qty", "price_in_period")


@query(
    """
    SELECT '199904' AS period, l_returnflag AS flag,
           CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (WHERE l_quantity >= 10 AND l_quantity < 30), 0) AS DOUBLE) AS middle,
           CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (WHERE NOT (l_linestatus = 'O') OR l_discount > 0.05), 0) AS DOUBLE) AS open_or_cut,
           CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (WHERE l_linenumber IN (1, 3) AND l_linestatus <> 'F'), 0) AS DOUBLE) AS picked,
           CAST(COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,2)))
                FILTER (WHERE CAST(l_quantity AS DECIMAL(18,2)) * 2 - 10 > CAST(l_linenumber AS DECIMAL(18,2)) * 5
                          AND l_linenumber % 2 = 1), 0) AS DOUBLE) AS computed,
           CAST(COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,2)))
                FILTER (WHERE strftime(l_shipdate, '%Y%m') IN ('199904', '199905')), 0) AS DOUBLE) AS two_months
    FROM lineitem GROUP BY 2"""
)
def rollup_python_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons, membership, boolean and arithmetic operators in rule conditions."""
    rules = bundle(
        group("flag", "l_returnflag"),
        total(
            "middle",
            "l_extendedprice",
            condition=lambda f: (f("l_quantity") >= 10) & (f("l_quantity") < 30),
        ),
        total(
            "open_or_cut",
            "l_extendedprice",
            condition=lambda f: ~(f("l_linestatus") == "O") | (f("l_discount") > 0.05),
        ),
        total(
            "picked",
            "l_extendedprice",
            condition=lambda f: f("l_linenumber").isin(1, 3) & (f("l_linestatus") != "F"),
        ),
        total(
            "computed",
            "l_quantity",
            condition=lambda f: (
                f.as_number(f("l_quantity")) * 2 - 10 > f.as_number(f("l_linenumber")) * 5
            )
            & (f("l_linenumber") % 2 == 1),
        ),
        total(
            "two_months",
            "l_quantity",
            condition=lambda f: f.period_of(f("l_shipdate")).isin("199904", "199905"),
        ),
    )
    lines = table_input(table(spark, sf_dir, "lineitem"))
    result = plan_rollup({"lines": lines}, rules, PERIOD).release()
    return as_double(result, "middle", "open_or_cut", "picked", "computed", "two_months")


@query(
    """
    SELECT '199904' AS period, o_orderpriority AS priority,
           CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2)))
                FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS finished,
           CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (
                WHERE strftime(o_orderdate, '%Y%m') = '199904'), 0) AS DOUBLE) AS in_period,
           CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (
                WHERE strftime(o_orderdate, '%Y%m') = '199905' AND o_totalprice > 1000), 0) AS DOUBLE) AS next_period
    FROM orders GROUP BY 2"""
)
def rollup_text_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions stored as Spark SQL text, with the helpers called by name."""
    install_sql_helpers(spark)
    next_month = "shift_period(current_period, 1)"
    rules = bundle(
        group("priority", "o_orderpriority"),
        total("finished", "o_totalprice", condition="`o_orderstatus` <=> 'F'"),
        total("in_period", "o_totalprice", condition="period_of(`o_orderdate`) = current_period"),
        total(
            "next_period",
            "o_totalprice",
            condition=f"period_of(`o_orderdate`) = {next_month} and `o_totalprice` > 1000",
        ),
    )
    orders = table_input(table(spark, sf_dir, "orders"))
    result = plan_rollup({"lines": orders}, rules, PERIOD).release()
    return as_double(result, "finished", "in_period", "next_period")


@query(
    """
    WITH sheets AS (
        SELECT CAST(o_orderkey % 100 AS VARCHAR) AS shop, o_orderstatus AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS billed, NULL AS qty FROM orders
        UNION ALL
        SELECT CAST(l_orderkey % 100 AS VARCHAR), NULL, NULL, CAST(l_quantity AS DECIMAL(18,2)) FROM lineitem)
    SELECT '199904' AS period, shop, status,
           CAST(COALESCE(SUM(billed), 0) AS DOUBLE) AS billed, CAST(COALESCE(SUM(qty), 0) AS DOUBLE) AS qty
    FROM sheets GROUP BY shop, status"""
)
def rollup_two_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets in one result; a sheet without a rule adds NULL keys and no amount."""
    shop = (F.col("o_orderkey") % 100).alias("shop")
    orders = table(spark, sf_dir, "orders").select(shop, "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("shop"), "l_quantity"
    )
    rules = bundle(
        group("shop", "shop", sheet="orders, lines"),
        group("status", "o_orderstatus", sheet="orders"),
        total("billed", "o_totalprice", sheet="orders"),
        total("qty", "l_quantity", sheet="lines"),
        sheets=("orders", "lines"),
    )
    inputs = {"orders": table_input(orders), "lines": table_input(lines)}
    result = plan_rollup(inputs, rules, PERIOD).release(backfill=False)
    return as_double(result, "billed", "qty")


@query(
    """
    SELECT '199904' AS period, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS absent,
           CAST(0 AS DOUBLE) AS no_column, CAST(0 AS DOUBLE) AS no_row,
           CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer GROUP BY 2"""
)
def rollup_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional columns that do not exist, and groups no row of which meets the condition."""
    rules = bundle(
        group("segment", "c_mktsegment"),
        group("absent", "no such column", optional=True),
        total("no_column", "no such amount", optional=True),
        total("no_row", "c_acctbal", condition=lambda f: f("c_mktsegment") == "no such segment"),
        total("balance", "c_acctbal"),
    )
    customers = table_input(table(spark, sf_dir, "customer"))
    result = plan_rollup({"lines": customers}, rules, PERIOD).release()
    return as_double(result, "no_column", "no_row", "balance")


# Orders with the customer's nation and segment; some cells are blank.
_GAPS_SQL = """
    SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE n_name END AS nation,
           CASE WHEN o_orderkey % 11 < 3 THEN NULL ELSE c_mktsegment END AS segment,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def _orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    nations = table(spark, sf_dir, "nation")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.when(key % 13 != 0, F.col("o_custkey")).alias("customer"),
        F.when(key % 7 != 0, F.col("n_name")).otherwise(F.lit("")).alias("nation"),
        F.when(key % 11 >= 3, F.col("c_mktsegment")).alias("segment"),
        F.col("o_totalprice").alias("amount"),
    )


@query(
    f"""
    WITH base AS (
        SELECT customer, nation, segment, SUM(amount) AS amount FROM ({_GAPS_SQL}) GROUP BY 1, 2, 3),
    a AS (SELECT CASE WHEN customer IS NULL AND lo = hi THEN lo ELSE customer END AS customer,
                 nation, segment, amount FROM (
            SELECT *, min(customer) OVER w AS lo, max(customer) OVER w AS hi FROM base
            WINDOW w AS (PARTITION BY nation, segment))),
    b AS (SELECT customer, CASE WHEN nation IS NULL AND lo = hi THEN lo ELSE nation END AS nation,
                 segment, amount FROM (
            SELECT *, min(nation) OVER w AS lo, max(nation) OVER w AS hi FROM a
            WINDOW w AS (PARTITION BY customer, segment))),
    c AS (SELECT customer, nation, CASE WHEN segment IS NULL AND lo = hi THEN lo ELSE segment END AS segment,
                 amount FROM (
            SELECT *, min(segment) OVER w AS lo, max(segment) OVER w AS hi FROM b
            WINDOW w AS (PARTITION BY customer, nation)))
    SELECT '199904' AS period, customer, nation, segment, CAST(SUM(amount) AS DOUBLE) AS amount
    FROM c GROUP BY 2, 3, 4"""
)
def rollup_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing group keys filled from unique candidates, field by field, then added up again."""
    rules = bundle(
        group("customer", "customer"),
        group("nation", "nation"),
        group("segment", "segment"),
        total("amount", "amount"),
    )
    rows = table_input(_orders_with_gaps(spark, sf_dir))
    return as_double(plan_rollup({"lines": rows}, rules, PERIOD).release(), "amount")


@query(
    """
    SELECT o_orderpriority AS priority, o_orderstatus AS status, min(o_orderkey) AS first_row
    FROM orders GROUP BY 1, 2"""
)
def rollup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place each group was seen, by which a result for people is sorted."""
    rules = bundle(group("priority", "o_orderpriority"), group("status", "o_orderstatus"))
    rows = table_input(table(spark, sf_dir, "orders"), row_no="o_orderkey")
    plan = plan_rollup({"lines": rows}, rules, PERIOD, ordered=True)
    return plan.groups.select(
        F.col("g0").alias("priority"),
        F.col("g1").alias("status"),
        F.col("__first.row_no").alias("first_row"),
    )


@query(
    f"""{_ORDERS_SQL}
    SELECT o_orderpriority AS source_file, 'lines' AS sheet, o_orderkey AS row_no, 'cell' AS field,
           CASE WHEN coalesce(n, '') = '' THEN 'SUM field ''cell'' is empty.'
                ELSE 'SUM field ''cell'' is not a number.' END AS message
    FROM norm
    WHERE o_orderstatus <> 'P' AND (coalesce(n, '') = '' OR TRY_CAST(n AS DECIMAL(28,6)) IS NULL)"""
)
def rollup_row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located issues of cells that cannot be summed; rows outside the condition raise none."""
    rows = table(spark, sf_dir, "orders").withColumn("cell", amount_cell())
    rules = bundle(
        group("priority", "o_orderpriority"),
        total("amount", "cell", condition=lambda f: f("o_orderstatus") != "P"),
    )
    given = table_input(rows, source_file="o_orderpriority", row_no="o_orderkey")
    return plan_rollup({"lines": given}, rules, PERIOD).issues()


@query(
    f"""{_ORDERS_SQL}
    SELECT o_orderkey AS row_no,
           CASE WHEN cell IS NOT NULL AND trim(cell, chr(9) || chr(12288) || ' ') <> '' AND n <> ''
                     AND TRY_CAST(n AS DECIMAL(28,6)) IS NULL
                     OR TRY_CAST(nullif(n, '') AS DECIMAL(28,6)) IS NULL
                THEN 'The condition could not be evaluated.' END AS message
    FROM norm WHERE o_orderstatus = 'O' AND (TRY_CAST(nullif(n, '') AS DECIMAL(28,6)) IS NULL)"""
)
def condition_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose condition cannot be decided; the right side of ``and`` only counts if reached."""
    rows = table(spark, sf_dir, "orders").withColumn("cell", amount_cell())
    rules = bundle(
        group("priority", "o_orderpriority"),
        total(
            "amount",
            "o_totalprice",
            condition=lambda f: (f("o_orderstatus") == "O") & (f.as_number(f("cell")) > 100),
        ),
    )
    given = table_input(rows, row_no="o_orderkey")
    return plan_rollup({"lines": given}, rules, PERIOD).issues().select("row_no", "message")


# Rule catalogs: every part is a rule of the project its brand stands for.

_RULES_SQL = """
    rules AS (
        SELECT p_brand AS project, p_name AS output,
               CASE WHEN p_size % 3 = 0 THEN 'GROUP' ELSE 'SUM' END AS kind,
               CASE p_partkey % 3 WHEN 0 THEN 'orders, lines ,' WHEN 1 THEN 'lines' ELSE 'DEFAULT' END AS sheet,
               CASE WHEN p_partkey % 4 = 0 THEN p_type END AS category, p_type AS field,
               p_size % 2 = 0 AS optional, p_partkey AS rule_no FROM part)
"""


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    sheet = (
        F.when(key % 3 == 0, F.lit("orders, lines ,"))
        .when(key % 3 == 1, F.lit("lines"))
        .otherwise(F.lit("DEFAULT"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"),
        F.col("p_name").alias("output"),
        F.when(size % 3 == 0, F.lit(R.GROUP)).otherwise(F.lit(R.SUM)).alias("kind"),
        sheet.alias("sheet"),
        F.when(key % 4 == 0, F.col("p_type")).alias("category"),
        F.col("p_type").alias("field"),
        (size % 2 == 0).alias("optional"),
        key.alias("rule_no"),
    )


@query(
    f"""WITH {_RULES_SQL}
    SELECT rule_no, trim(name) AS logical_sheet
    FROM (SELECT rule_no, unnest(string_split(sheet, ',')) AS name FROM rules) WHERE trim(name) <> ''"""
)
def rule_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical sheets every rule of a catalog applies to."""
    sheets = R.applicable_sheets(rule_catalog(spark, sf_dir))
    return sheets.select("rule_no", "logical_sheet")


@query(
    f"""WITH {_RULES_SQL}
    SELECT project, output, rule_no, sheet, field FROM (
        SELECT *, row_number() OVER (PARTITION BY project, output ORDER BY rule_no) AS n
        FROM rules WHERE kind = 'GROUP') WHERE n = 1"""
)
def first_group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First GROUP rule per output name of every project."""
    first = R.first_rule_per_output(rule_catalog(spark, sf_dir))
    return first.select("project", "output", "rule_no", "sheet", "field")


@query(
    f"""WITH {_RULES_SQL}
    SELECT project, output, count(*) AS rule_count FROM rules WHERE kind = 'SUM'
    GROUP BY 1, 2 HAVING count(*) > 1"""
)
def shared_sum_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM outputs fed by more than one rule, which a bundle must not have."""
    return R.shared_sum_outputs(rule_catalog(spark, sf_dir))


@query("SELECT p_name, count(*) AS occurrences FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once."""
    return R.duplicate_ids(table(spark, sf_dir, "part"), "p_name")


@query(
    """
    SELECT p_brand AS project, p_name AS output, CASE WHEN p_size % 3 = 0 THEN 'GROUP' ELSE 'SUM' END AS kind,
           p_type AS field, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS category,
           p_size % 2 = 0 AS optional
    FROM part"""
)
def read_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a configuration table with wrapped cells and both project columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    wrapped = F.concat(F.lit('[{"text":"'), F.col("p_name"), F.lit('","type":"text"}]'))
    raw = table(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, F.col("p_brand")).alias("recog_id"),
        F.when(key % 2 == 1, F.col("p_brand")).alias("recognition_id"),
        wrapped.alias("output"),
        F.when(size % 3 == 0, F.lit(" group ")).otherwise(F.lit("sum")).alias("kind"),
        F.lit("DEFAULT").alias("sheet"),
        F.when(key % 2 == 0, F.lit("  ")).otherwise(F.col("p_type")).alias("category"),
        F.col("p_type").alias("field"),
        F.lit(None).cast("string").alias("condition"),
        F.when(size % 2 == 0, F.lit("Yes")).otherwise(F.lit("0")).alias("optional"),
    )
    rules = R.read_rules(raw)
    return rules.select("project", "output", "kind", "field", "category", "optional")


@query(
    """
    SELECT p_brand AS project, 'sheet' || p_size AS sheet,
           CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size % 5 AS INT) END AS category_row,
           CAST(p_size AS INT) AS field_row, CAST(-(p_partkey % 4) AS INT) AS last_row, p_partkey % 2 = 1 AS optional
    FROM part"""
)
def read_sheet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet layouts read from a configuration table that holds text only."""
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("recog_id"),
        F.concat(F.lit("sheet"), size).alias("sheet"),
        F.when(key % 3 == 0, F.lit("")).otherwise((size % 5).cast("string")).alias("category_row"),
        F.concat(F.lit(" "), size.cast("string")).alias("field_row"),
        (-(key % 4)).cast("string").alias("last_row"),
        F.when(key % 2 == 1, F.lit("true")).otherwise(F.lit("no")).alias("optional"),
    )
    return R.read_specs(raw)


@query(
    """
    SELECT '199904' AS period, o_orderstatus AS status, o_orderpriority AS priority,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders GROUP BY 2, 3"""
)
def rollup_patched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project patch adds a GROUP rule before the rollup runs."""
    book = R.PatchBook()
    book.register("demo", R.add_rule(group("priority", "o_orderpriority")))
    rules = book.apply(bundle(group("status", "o_orderstatus"), total("amount", "o_totalprice")))
    orders = table_input(table(spark, sf_dir, "orders"))
    return as_double(plan_rollup({"lines": orders}, rules, PERIOD).release(), "amount")


@query(
    """
    SELECT '199904' AS period, o_orderstatus AS status,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE)
               AS by_category,
           CAST(SUM(CAST(o_custkey AS DECIMAL(18,2))) AS DOUBLE) AS by_field
    FROM orders GROUP BY 2"""
)
def rollup_two_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields addressed by category and name, in rules and in conditions."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.col("o_totalprice").alias("a"),
        F.col("o_custkey").alias("b"),
        F.col("o_orderpriority").alias("c"),
        money_text("o_totalprice").alias("d"),
    )
    places = {
        "a": ("money", "amount"),
        "b": (None, "amount"),
        "c": ("kind", "priority"),
        "d": ("kind", "amount"),
    }
    rules = bundle(
        group("status", "o_orderstatus"),
        total(
            "by_category",
            "amount",
            category="money",
            condition=lambda f: f("kind_priority") == "1-URGENT",
        ),
        total("by_field", "amount"),
    )
    given = table_input(rows, categories=places)
    result = plan_rollup({"lines": given}, rules, PERIOD).release()
    return as_double(result, "by_category", "by_field")


# Condition texts with what they are in SQL: where they hold, and where they have no outcome.
_NOTE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE 'n' || o_orderkey % 10 END"
_MONTH = "strftime(o_orderdate, '%Y%m')"
OUTCOMES = {
    'F("note") == "n2"': ("note IS NOT DISTINCT FROM 'n2'", "false"),
    'F("note") != "n2"': ("note IS DISTINCT FROM 'n2'", "false"),
    "`note` = 'n2' or `note` is null": ("note IS NULL OR note = 'n2'", "false"),
    'F("note") == 5': ("false", "false"),
    'F("note") > 5': ("false", "true"),
    'F("note") > "n3"': ("note > 'n3'", "note IS NULL"),
    'F("note") in ["n2", None, 7]': ("note IS NULL OR note = 'n2'", "false"),
    "`note` not in ('n2', 'n4')": ("note IS NULL OR note NOT IN ('n2', 'n4')", "false"),
    '"n" in F("note")': ("contains(note, 'n')", "note IS NULL"),
    'F("note")': ("note <> ''", "false"),
    'not F("note") and F("o_totalprice") >= 1000': ("coalesce(note, '') = '' AND o_totalprice >= 1000", "false"),
    'F("note") + "x" == "n2x"': ("note = 'n2'", "note IS NULL"),
    '-F("note") == 1': ("false", "true"),
    'F("note") and F("note") > 5': ("false", "note <> ''"),
    'F("o_orderkey") % 3 == 1 and F("o_totalprice") / F("zero") > 1': ("false", "o_orderkey % 3 = 1"),
    'F("o_orderkey") % 3 == 1 or F("o_totalprice") / F("zero") > 1': ("o_orderkey % 3 = 1", "o_orderkey % 3 <> 1"),
    'period_of(F("o_orderdate")) == 199905': ("false", "false"),
    'period_of(F("o_orderdate")) == current_period': (f"{_MONTH} = '199905'", "false"),
    "period_of(`o_orderdate`) = add_months(current_period, -1)": (f"{_MONTH} = '199904'", "false"),
    'F("o_orderdate") == "1999-05-01"': ("false", "false"),
    '1000 < F("o_totalprice") < 100000': ("o_totalprice > 1000 AND o_totalprice < 100000", "false"),
    'as_number(F("note")) == "x"': ("false", "note <> ''"),
    'is_blank(F("note")) == True': ("coalesce(note, '') = ''", "false"),
}


@query(
    f"""
    WITH o AS (SELECT *, {_NOTE} AS note FROM orders),
    found AS ({" UNION ALL ".join(
        f"SELECT '{text.replace(chr(39), chr(39) * 2)}' AS condition, coalesce({bad}, false) AS bad, coalesce({holds}, false) AS holds FROM o"
        for text, (holds, bad) in OUTCOMES.items()
    )})
    SELECT condition, count(*) FILTER (NOT bad AND holds) AS holding, count(*) FILTER (NOT bad AND NOT holds) AS failing,
        count(*) FILTER (bad) AS undecided FROM found GROUP BY condition"""
)
def condition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often conditions of both spellings hold, fail, and have no outcome; one pass for all."""
    key = F.col("o_orderkey")
    note = F.when(key % 5 == 0, None).when(key % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("n"), (key % 10).cast("string")))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderdate", note.alias("note"), F.lit(0).alias("zero")
    )
    given = table_input(orders)

    def lookup(name: str) -> conditions.Term:
        (source,) = given.by_name(name)
        return conditions.Term(source.column, kind=source.kind)

    terms = {text: conditions.build(text, lookup, "199905") for text in OUTCOMES}
    never = F.lit(False)
    counts = [
        F.struct(
            F.lit(text).alias("condition"),
            F.count_if(term.value).alias("holding"),
            F.count_if(~term.value & ~(never if term.bad is None else term.bad)).alias("failing"),
            F.count_if(never if term.bad is None else term.bad).alias("undecided"),
        )
        for text, term in terms.items()
    ]
    return orders.agg(F.array(*counts).alias("found")).select(F.explode("found").alias("c")).select("c.*")
