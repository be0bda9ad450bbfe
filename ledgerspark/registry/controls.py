"""Reconciliation, load strategies, target checks and the project catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.names import named
from ledgerspark.operators import load
from ledgerspark.operators.versions import VersionedTable
from ledgerspark.operators.reconcile import Comparison, compare, confirmation_message
from ledgerspark.plans.rollup import plan_rollup, table_input
from ledgerspark.plans.validate import error_count, expected_target_fields, target_checks
from ledgerspark.registry.base import as_double, query, table
from ledgerspark.registry.rollups import _RULES_SQL, bundle, group, rule_catalog, total
from ledgerspark.session import scratch_path, settle
from ledgerspark.sources import config
from ledgerspark.sources.config import list_projects, read_projects
from ledgerspark.sources.target import baseline_rows, flatten, period_rows

PERIOD = "199904"

# A rollup per customer: amount of all orders and of finished orders.
_RESULT_SQL = """
    result AS (
        SELECT '199904' AS period, CAST(o_custkey AS VARCHAR) AS customer,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount,
               CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0)
                    AS DECIMAL(38,2)) AS finished
        FROM orders GROUP BY o_custkey)
"""


def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = bundle(
        group("customer", "o_custkey"),
        total("amount", "o_totalprice"),
        total("finished", "o_totalprice", condition=lambda f: f("o_orderstatus") == "F"),
    )
    orders = table_input(table(spark, sf_dir, "orders"))
    return plan_rollup({"lines": orders}, rules, PERIOD).result()


# The same customers as a baseline would hold them: other types and notations, some rows missing,
# some added, some amounts changed.
_BASELINE_SQL = f"""
    {_RESULT_SQL},
    baseline AS (
        SELECT 199904 AS period,
               CASE WHEN CAST(customer AS BIGINT) % 3 = 0 THEN ' 00' || customer || ' ' ELSE customer END AS customer,
               CASE WHEN CAST(customer AS BIGINT) % 10 = 4 THEN amount + 1 ELSE amount END AS amount,
               CASE WHEN CAST(customer AS BIGINT) % 15 = 4 THEN NULL ELSE finished END AS finished
        FROM result WHERE CAST(customer AS BIGINT) % 12 <> 7
        UNION ALL
        SELECT 199904, 'new-' || customer, amount, finished FROM result WHERE CAST(customer AS BIGINT) % 20 = 1)
"""


def customer_baseline(result: DataFrame) -> DataFrame:
    number = F.col("customer").cast("bigint")
    padded = F.concat(F.lit(" 00"), "customer", F.lit(" "))
    changed = F.when(number % 10 == 4, F.col("amount") + 1).otherwise(F.col("amount"))
    kept = result.where(number % 12 != 7).select(
        F.lit(199904).alias("period"),
        F.when(number % 3 == 0, padded).otherwise(F.col("customer")).alias("customer"),
        F.concat(F.lit(" "), changed.cast("string")).alias("amount"),
        F.when(number % 15 != 4, F.col("finished").cast("string")).alias("finished"),
    )
    added = result.where(number % 20 == 1).select(
        F.lit(199904).alias("period"),
        F.concat(F.lit("new-"), "customer").alias("customer"),
        F.col("amount").cast("string").alias("amount"),
        F.col("finished").cast("string").alias("finished"),
    )
    return kept.unionByName(added)


def customer_comparison(spark: SparkSession, sf_dir: str) -> Comparison:
    result = customer_rollup(spark, sf_dir)
    return compare(result, customer_baseline(result), ["period", "customer"])


_DIFF_SQL = f"""
    {_BASELINE_SQL},
    b AS (SELECT CASE WHEN customer LIKE 'new-%' THEN customer
                      ELSE CAST(CAST(trim(customer) AS BIGINT) AS VARCHAR) END AS key, amount, finished FROM baseline),
    joined AS (
        SELECT coalesce(r.customer, b.key) AS customer, r.customer IS NULL AS no_preview,
               b.key IS NULL AS no_baseline, r.amount AS a1, b.amount AS a2, r.finished AS f1, b.finished AS f2
        FROM result r FULL JOIN b ON r.customer = b.key),
    diffs AS (
        SELECT customer, 'missing_in_preview' AS issue_type, '__record__' AS field, NULL AS preview_value,
               NULL AS baseline_value FROM joined WHERE no_preview
        UNION ALL SELECT customer, 'missing_in_baseline', '__record__', NULL, NULL FROM joined WHERE no_baseline
        UNION ALL SELECT customer, 'value_mismatch', 'amount', CAST(a1 AS VARCHAR), CAST(a2 AS VARCHAR) FROM joined
            WHERE NOT no_preview AND NOT no_baseline AND a1 IS DISTINCT FROM a2
        UNION ALL SELECT customer, 'value_mismatch', 'finished', CAST(f1 AS VARCHAR), CAST(f2 AS VARCHAR) FROM joined
            WHERE NOT no_preview AND NOT no_baseline AND f1 IS DISTINCT FROM f2)
"""


@query(
    f"""WITH {_DIFF_SQL}
    SELECT '199904' AS period, customer, '199904|' || customer AS key_text, issue_type, field,
           preview_value, baseline_value FROM diffs"""
)
def reconcile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing records and differing fields of a rollup against its baseline."""
    found = customer_comparison(spark, sf_dir).differences()
    record = F.col("field") == "__record__"
    return found.withColumns(
        {
            name: F.when(~record, F.col(name))
            for name in ("preview_value", "baseline_value")
        }
    )


@query(
    f"""WITH {_DIFF_SQL}
    SELECT count(DISTINCT customer) = 0 AS matched, (SELECT count(*) FROM result) AS preview_count,
           (SELECT count(*) FROM baseline) AS baseline_count, count(DISTINCT customer) AS difference_count,
           'period,customer' AS key_fields,
           CASE WHEN count(DISTINCT issue_type) = 0 THEN 'matched'
                WHEN count(DISTINCT issue_type) = 1 THEN max(issue_type) ELSE 'mixed' END AS diff_type,
           count(*) > 0 AS needs_confirmation,
           CASE WHEN count(*) = 0 THEN 'proceed' ELSE 'report_to_business_owner' END AS next_action
    FROM diffs"""
)
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts, kind of difference and the next action."""
    return customer_comparison(spark, sf_dir).summary()


@query(
    f"""WITH {_DIFF_SQL}
    SELECT 'Preview 与 baseline 存在差异，recog_id=demo，period=199904，diff_type=' ||
           CASE WHEN count(DISTINCT issue_type) = 1 THEN max(issue_type) ELSE 'mixed' END ||
           '，difference_count=' || count(DISTINCT customer) ||
           '。请先向业务负责人汇报差异和判断建议，确认口径后再继续迭代。' AS message
    FROM diffs HAVING count(*) > 0"""
)
def reconcile_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmation text for the business owner."""
    summary = customer_comparison(spark, sf_dir).summary()
    return confirmation_message(summary, "demo", PERIOD)


@query(
    """
    WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n,
                      count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
    b AS (SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(c_acctbal AS DECIMAL(18,2)) AS amount FROM customer)
    SELECT coalesce(a.customer, b.customer) AS customer, a.size AS preview_n,
           CASE WHEN b.customer IS NULL THEN NULL ELSE CAST(1 AS BIGINT) END AS baseline_n,
           CASE WHEN a.customer IS NULL THEN 'missing_in_preview' WHEN b.customer IS NULL THEN 'missing_in_baseline'
                WHEN a.amount <> b.amount THEN 'value_mismatch' END AS issue_type
    FROM (SELECT * FROM a WHERE n = 1) a FULL JOIN b ON a.customer = b.customer"""
)
def reconcile_last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where several records share a key the last one is compared; the count shows it."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"), "o_orderkey"
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer"),
        F.col("c_acctbal").alias("amount"),
        F.lit(0).alias("o_orderkey"),
    )
    found = compare(orders, customers, ["customer"], order="o_orderkey")
    return found.joined.select("customer", "preview_n", "baseline_n", "issue_type")


# The target table: the baseline's rows with record ids, for two periods.
_TARGET_SQL = f"""
    {_BASELINE_SQL},
    target AS (
        SELECT 'rec-' || trim(customer) AS record_id, period, customer, amount, finished FROM baseline
        UNION ALL SELECT 'old-' || trim(customer), 199903, customer, amount, finished FROM baseline)
"""


def customer_target(result: DataFrame) -> DataFrame:
    base = customer_baseline(result).select(
        "period",
        "customer",
        F.trim("amount").cast("decimal(38,2)").alias("amount"),
        F.col("finished").cast("decimal(38,2)").alias("finished"),
    )
    name = F.trim("customer")
    now = base.withColumn("record_id", F.concat(F.lit("rec-"), name))
    old = base.withColumn("record_id", F.concat(F.lit("old-"), name))
    return now.unionByName(old.withColumn("period", F.lit(199903)))


_ACTIONS_SQL = f"""
    {_TARGET_SQL},
    t AS (SELECT *, CASE WHEN customer LIKE 'new-%' THEN customer
                         ELSE CAST(CAST(trim(customer) AS BIGINT) AS VARCHAR) END AS key
          FROM target WHERE period = 199904),
    actions AS (
        SELECT r.period, r.customer, r.amount, r.finished, t.record_id,
               CASE WHEN t.record_id IS NULL THEN 'insert'
                    WHEN r.amount IS DISTINCT FROM t.amount OR r.finished IS DISTINCT FROM t.finished
                    THEN 'update' ELSE 'noop' END AS action
        FROM result r LEFT JOIN t ON t.key = r.customer)
"""


def customer_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    result = customer_rollup(spark, sf_dir)
    target = customer_target(result)
    current = period_rows(target, PERIOD)
    return result, current, load.plan_upsert(result, current, ["period", "customer"])


@query(
    f"""WITH {_ACTIONS_SQL}
    SELECT customer, CAST(amount AS DOUBLE) AS amount, CAST(finished AS DOUBLE) AS finished, record_id, action
    FROM actions"""
)
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update or leave alone: every source row against the target's period."""
    actions = customer_actions(spark, sf_dir)[2].drop("period")
    return as_double(actions, "amount", "finished")


@query(
    f"""WITH {_ACTIONS_SQL}
    SELECT coalesce(t.record_id, 'fresh') AS record_id, coalesce(t.period, 199904) AS period,
           CASE WHEN a.action = 'update' THEN a.customer ELSE t.customer END AS customer,
           CAST(CASE WHEN a.action = 'update' THEN a.amount ELSE t.amount END AS DOUBLE) AS amount,
           CAST(CASE WHEN a.action = 'update' THEN a.finished ELSE t.finished END AS DOUBLE) AS finished
    FROM t LEFT JOIN actions a ON a.record_id = t.record_id
    UNION ALL
    SELECT 'fresh', 199904, customer, CAST(amount AS DOUBLE), CAST(finished AS DOUBLE)
    FROM actions WHERE action = 'insert'"""
)
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's period after the upsert; rows nobody sent are still there."""
    result, current, actions = customer_actions(spark, sf_dir)
    state = load.merged_state(actions, current, result.columns, new_id=F.lit("fresh"))
    return as_double(state, "amount", "finished")


@query(
    f"""WITH {_ACTIONS_SQL}
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(SUM(CAST(period AS BIGINT)) AS BIGINT) AS period_sum,
           CAST(SUM(amount) AS DOUBLE) AS amount FROM (
        SELECT CASE WHEN a.action = 'update' THEN a.amount ELSE t.amount END AS amount, t.period
        FROM t LEFT JOIN actions a ON a.record_id = t.record_id
        UNION ALL SELECT amount, 199904 FROM actions WHERE action = 'insert'
        UNION ALL SELECT amount, period FROM target WHERE period = 199903)"""
)
def upsert_stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert into a stored, period-partitioned table, twice; the other period is untouched."""
    result = customer_rollup(spark, sf_dir)
    path = scratch_path(spark, "target")
    customer_target(result).write.partitionBy("period").parquet(path)
    for _ in range(2):
        load.upsert(spark, result, path, PERIOD, ["period", "customer"])
    stored = spark.read.parquet(path)
    return stored.agg(
        F.count("*").alias("rows"),
        F.sum(F.col("period").cast("bigint")).alias("period_sum"),
        F.sum("amount").cast("double").alias("amount"),
    )


@query(
    f"""WITH {_TARGET_SQL}
    SELECT p AS period, count(record_id) AS existing_count, count(record_id) > 0 AS conflict
    FROM (VALUES ('199903'), ('199904'), ('199905')) v(p)
    LEFT JOIN target ON CAST(target.period AS VARCHAR) = p GROUP BY 1"""
)
def period_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a period already has rows, which stops the default load."""
    target = customer_target(customer_rollup(spark, sf_dir))
    report = load.period_conflict(target, "199903")
    for period in ("199904", "199905"):
        report = report.unionByName(load.period_conflict(target, period))
    return report


@query(
    f"""WITH {_TARGET_SQL}
    SELECT period, customer, CAST(amount AS DOUBLE) AS amount FROM target WHERE period = 199904"""
)
def baseline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns of one period of a stored target; only its partition is read."""
    path = scratch_path(spark, "baseline")
    target = customer_target(customer_rollup(spark, sf_dir))
    target.write.partitionBy("period").parquet(path)
    rows = baseline_rows(spark.read.parquet(path), PERIOD, ["customer", "amount"])
    return as_double(rows, "amount")


@query(
    f"""WITH {_RESULT_SQL}
    SELECT '199904' AS period, customer, CAST(amount AS DOUBLE) AS amount, CAST(finished AS DOUBLE) AS finished,
           'demo' AS project, 'customer' AS group_fields FROM result"""
)
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as an artifact and read back with its metadata."""
    result = customer_rollup(spark, sf_dir)
    folder = scratch_path(spark, "artifacts")
    path = load.write_artifact(result, folder, "demo", PERIOD, ["customer"])
    rows, metadata = load.read_artifact(spark, path, "demo")
    return as_double(rows, "amount", "finished").withColumns(
        {
            "project": F.lit(metadata["project"]),
            "group_fields": F.lit(",".join(metadata["group_fields"])),
        }
    )


@query(
    f"""WITH {_RESULT_SQL}
    SELECT customer, CAST(SUM(amount) AS DOUBLE) AS amount, count(*) AS copies
    FROM (SELECT * FROM result UNION ALL SELECT * FROM result) GROUP BY 1"""
)
def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append adds all rows, also when they are there already."""
    result = customer_rollup(spark, sf_dir)
    path = scratch_path(spark, "appended")
    load.append(result, path)
    load.append(result, path)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("customer").cast("string").alias("customer"))
        .agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("copies"))
    )


@query(f"WITH {_RESULT_SQL} SELECT count(*) AS row_count, 4 AS field_count FROM result")
def result_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and field count of a result."""
    return load.overview(customer_rollup(spark, sf_dir))


_OUTBOUND_SQL = """
    raw AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)
                   WHEN 2 THEN '1,000' WHEN 3 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS amount,
                   ' ' || c_name AS name FROM customer)
"""


@query(
    f"""WITH {_OUTBOUND_SQL}
    SELECT c_custkey, CAST(TRY_CAST(trim(amount) AS DECIMAL(28,6)) AS DOUBLE) AS amount, name FROM raw"""
)
def outbound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the type of the target's fields: number fields parse text, blanks are NULL."""
    typed = load.outbound(_outbound_rows(spark, sf_dir), {"amount": 2, "name": 1})
    return as_double(typed, "amount")


@query(
    f"""WITH {_OUTBOUND_SQL}
    SELECT 'amount' AS field, amount AS value FROM raw
    WHERE coalesce(trim(amount), '') <> '' AND TRY_CAST(trim(amount) AS DECIMAL(28,6)) IS NULL"""
)
def outbound_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values a number field of the target cannot take."""
    return load.outbound_problems(_outbound_rows(spark, sf_dir), {"amount": 2, "name": 1})


def _outbound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    amount = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    cell = (
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 5 == 1, F.concat(F.lit(" "), amount))
        .when(key % 5 == 2, F.lit("1,000"))
        .when(key % 5 == 3, F.lit(None))
        .otherwise(key.cast("string"))
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", cell.alias("amount"), F.concat(F.lit(" "), "c_name").alias("name")
    )


@query(
    """
    SELECT event_id, event_type AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events"""
)
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target records whose fields arrive as wrapped values."""
    k = F.get_json_object("props", "$.k")
    wrapped = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit('[{"text":"'), "event_type", F.lit('","type":"text"}]')).alias("name"),
        F.concat(F.lit('{"type":2,"value":['), k, F.lit("]}")).alias("k"),
    )
    return flatten(wrapped, ["name", "k"])


# Catalog and target metadata of many projects: brands are projects, customers and orders tables.


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS project, c_name AS project_name,
           CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 't-' || c_custkey END AS target_table,
           c_custkey % 9 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS target_exists
    FROM customer"""
)
def project_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with a flag that tells whether their target table exists."""
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit('[{"text":"'), key.cast("string"), F.lit('"}]')).alias("project"),
        F.col("c_name").alias("project_name"),
        F.when(key % 9 != 0, F.concat(F.lit("t-"), key.cast("string"))).alias("target_table"),
    )
    tables = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t-"), F.col("o_custkey").cast("string")).alias("target_table")
    )
    return list_projects(read_projects(raw), tables)


_EXPECTED_SQL = f"""
    {_RULES_SQL},
    firsts AS (SELECT project, output, kind FROM (
        SELECT *, row_number() OVER (PARTITION BY project, output ORDER BY rule_no) AS n FROM rules) WHERE n = 1),
    expected AS (
        SELECT project, output AS field_name, CASE WHEN kind = 'SUM' THEN [2] ELSE [1, 3] END AS allowed FROM firsts
        UNION ALL SELECT DISTINCT project, 'period', [1, 2] FROM rules),
    actual AS (
        SELECT DISTINCT p_brand AS project, p_name AS field_name, length(p_name) % 3 + 1 AS type FROM part
        WHERE length(p_name) % 5 <> 0
        UNION ALL SELECT DISTINCT p_brand, 'period', length(p_brand) % 3 + 1 FROM part WHERE length(p_brand) = 7),
    met AS (SELECT e.*, a.type FROM expected e LEFT JOIN actual a USING (project, field_name)),
    checks AS (
        SELECT project, 'target_field_exists' AS check_name, 'target_field:' || field_name AS scope,
               type IS NOT NULL AS passed,
               CASE WHEN type IS NULL THEN 'Target field is missing in the target table.'
                    ELSE 'Target field exists in the target table.' END AS message FROM met
        UNION ALL
        SELECT project, 'target_field_type', 'target_field:' || field_name, list_contains(allowed, type),
               CASE WHEN list_contains(allowed, type)
                    THEN 'Target field type is compatible with the inferred expectation.'
                    ELSE 'Target field type does not match the inferred expectation.' END
        FROM met WHERE type IS NOT NULL)
"""


def _target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_catalog(spark, sf_dir)
    projects = rules.select("project").distinct().withColumn("target_table", F.col("project"))
    part = table(spark, sf_dir, "part")
    length = F.length("p_name")
    named_fields = part.where(length % 5 != 0).select(
        F.col("p_brand").alias("target_table"),
        F.col("p_name").alias("field_name"),
        (length % 3 + 1).alias("type"),
    )
    brand = F.length("p_brand")
    periods = part.where(brand == 7).select(
        F.col("p_brand").alias("target_table"),
        F.lit("period").alias("field_name"),
        (brand % 3 + 1).alias("type"),
    )
    fields = named_fields.unionByName(periods).distinct()
    return target_checks(expected_target_fields(projects, rules), fields)


@query(f"WITH {_EXPECTED_SQL} SELECT project, check_name, scope, passed, message FROM checks")
def check_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target columns of every project: present, and of a type that fits."""
    return _target_report(spark, sf_dir).drop("details")


@query(f"WITH {_EXPECTED_SQL} SELECT count(*) FILTER (WHERE NOT passed) AS error_count FROM checks")
def check_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of failed checks, which decides whether a job goes on."""
    return error_count(_target_report(spark, sf_dir))


@query(
    f"""WITH {_RESULT_SQL}
    SELECT replace(replace(CASE WHEN CAST(customer AS BIGINT) % 2 = 0 THEN '（' || customer || '）'
                   ELSE '(' || customer || ')' END, '（', '('), '）', ')') AS key_text, 2 AS rows
    FROM result"""
)
def doubled_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows that would hit the same target row once their keys are normalized."""
    result = customer_rollup(spark, sf_dir)
    wide = result.withColumn("customer", F.concat(F.lit("（"), "customer", F.lit("）")))
    narrow = result.withColumn("customer", F.concat(F.lit("("), "customer", F.lit(")")))
    found = load.duplicate_source_keys(wide.unionByName(narrow), ["customer"])
    return found.select(named("__k0").alias("key_text"), "rows")


@query(
    """
    WITH catalog AS (
        SELECT p_brand AS project, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE 'bills_' || min(p_type) END AS target_table
        FROM part GROUP BY p_brand),
    tables AS (SELECT DISTINCT 'bills_' || p_type AS target_table FROM part WHERE p_size <= 12),
    requested AS (SELECT p_brand AS project FROM part UNION SELECT s_name FROM supplier)
    SELECT r.project, CASE WHEN c.project IS NULL THEN 'project ' || r.project || ' is not registered'
            WHEN t.target_table IS NULL THEN 'the target table of project ' || r.project || ' was not found' END AS stopped,
        t.target_table
    FROM requested r LEFT JOIN catalog c ON r.project = c.project LEFT JOIN tables t ON c.target_table = t.target_table"""
)
def project_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a run before it reads anything: projects that are not registered, targets that are missing."""
    part = table(spark, sf_dir, "part")
    catalog = part.groupBy(F.col("p_brand").alias("project")).agg(
        F.min("p_type").alias("kind"), F.lit("").alias("project_name")
    ).select(
        "project", "project_name",
        F.when(~F.col("project").endswith("3"), F.concat(F.lit("bills_"), "kind")).alias("target_table"),
    )
    tables = part.where("p_size <= 12").select(F.concat(F.lit("bills_"), "p_type").alias("target_table"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"))
    requested = part.select(F.col("p_brand").alias("project")).unionByName(suppliers)
    return config.project_gates(requested, config.list_projects(catalog, tables))


@query(
    f"""WITH {_ACTIONS_SQL}
    SELECT coalesce(t.record_id, 'fresh') AS record_id, coalesce(t.period, 199904) AS period,
           CASE WHEN a.action = 'update' THEN a.customer ELSE t.customer END AS customer,
           CAST(CASE WHEN a.action = 'update' THEN a.amount ELSE t.amount END AS DOUBLE) AS amount,
           CAST(CASE WHEN a.action = 'update' THEN a.finished ELSE t.finished END AS DOUBLE) AS finished
    FROM t LEFT JOIN actions a ON a.record_id = t.record_id
    UNION ALL
    SELECT 'fresh', 199904, customer, CAST(amount AS DOUBLE), CAST(finished AS DOUBLE)
    FROM actions WHERE action = 'insert'"""
)
def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a table whose periods are swapped as a whole, after two loads and a staged one
    that was never switched to."""
    result = customer_rollup(spark, sf_dir)
    before = settle(period_rows(customer_target(result), PERIOD).withColumn("period", F.col("period").cast("string")))
    table = VersionedTable(spark, scratch_path(spark, "versions"), before._jdf.schema().toDDL())
    table.replace(before, PERIOD)
    for _ in range(2):
        table.upsert(result, PERIOD, ["period", "customer"], new_id=F.lit("fresh"))
    table.stage(before.limit(0), PERIOD)
    found = table.read().withColumn("period", F.col("period").cast("bigint"))
    return as_double(found, "amount", "finished")
