"""Cell values: blanks, numbers, periods and comparison forms over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import nested, text, values
from ledgerspark.functions.conditions import install_sql_helpers
from ledgerspark.registry.base import money_text, query, table

_WS = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"

# One messy amount cell per order: plain, grouped, marked, dashed, blank or broken text.
_AMOUNT_SQL = """
    CASE o_orderkey % 11
        WHEN 0 THEN '`' || amt || ' '
        WHEN 1 THEN '  ' || amt
        WHEN 2 THEN '-'
        WHEN 3 THEN '——'
        WHEN 4 THEN ''
        WHEN 5 THEN NULL
        WHEN 6 THEN amt || 'd'
        WHEN 7 THEN '12%'
        WHEN 8 THEN '1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.50'
        WHEN 9 THEN chr(12288) || chr(9)
        ELSE amt END
"""
_ORDERS_SQL = f"""
    WITH cells AS (
        SELECT *, {_AMOUNT_SQL} AS cell FROM (
            SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amt FROM orders)),
    bare AS (
        SELECT *, trim(replace(replace(cell, ',', ''), '`', ''), {_WS}) AS stripped FROM cells),
    norm AS (
        SELECT *, CASE WHEN regexp_full_match(stripped, '[-—–－]+') THEN '0' ELSE stripped END AS n
        FROM bare)
"""


def amount_cell() -> Column:
    amount = money_text("o_totalprice")
    grouped = F.concat(
        F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(".50")
    )
    kind = F.col("o_orderkey") % 11
    return (
        F.when(kind == 0, F.concat(F.lit("`"), amount, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("  "), amount))
        .when(kind == 2, F.lit("-"))
        .when(kind == 3, F.lit("——"))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.lit(None).cast("string"))
        .when(kind == 6, F.concat(amount, F.lit("d")))
        .when(kind == 7, F.lit("12%"))
        .when(kind == 8, grouped)
        .when(kind == 9, F.lit("　\t"))
        .otherwise(amount)
    )


@query(
    f"""{_ORDERS_SQL}
    SELECT o_orderkey, cell IS NULL OR trim(cell, {_WS}) = '' AS blank,
           cell IS NOT NULL AND trim(cell, {_WS}) <> '' AS filled,
           n AS text, CAST(TRY_CAST(n AS DECIMAL(28,6)) AS DOUBLE) AS number,
           cell IS NOT NULL AND trim(cell, {_WS}) <> '' AND n <> ''
               AND TRY_CAST(n AS DECIMAL(28,6)) IS NULL AS broken
    FROM norm"""
)
def cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank tests, numeric text and numbers of messy amount cells."""
    cells = table(spark, sf_dir, "orders").select("o_orderkey", amount_cell().alias("cell"))
    cell = F.col("cell")
    return cells.select(
        "o_orderkey",
        values.is_blank(cell).alias("blank"),
        values.has_value(cell).alias("filled"),
        values.numeric_text(cell).alias("text"),
        values.as_number(cell).cast("double").alias("number"),
        F.coalesce(values.as_number_invalid(cell), F.lit(False)).alias("broken"),
    )


@query(
    f"""{_ORDERS_SQL}
    SELECT o_orderkey,
           CAST(CASE WHEN coalesce(n, '') = '' THEN 0 ELSE TRY_CAST(n AS DECIMAL(28,6)) END AS DOUBLE)
               AS optional_value,
           CAST(TRY_CAST(n AS DECIMAL(28,6)) AS DOUBLE) AS required_value,
           coalesce(n, '') = '' AS empty,
           coalesce(n, '') <> '' AND TRY_CAST(n AS DECIMAL(28,6)) IS NULL AS unreadable
    FROM norm"""
)
def sum_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a SUM rule adds for each cell, and where it would fail."""
    cells = table(spark, sf_dir, "orders").select("o_orderkey", amount_cell().alias("cell"))
    cell = F.col("cell")
    return cells.select(
        "o_orderkey",
        values.sum_value(cell, optional=True).cast("double").alias("optional_value"),
        values.sum_value(cell, optional=False).cast("double").alias("required_value"),
        values.sum_empty(cell).alias("empty"),
        values.sum_unreadable(cell).alias("unreadable"),
    )


_DATE_SQL = """
    CASE o_orderkey % 8
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y%m')
        WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')
        WHEN 4 THEN year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日'
        WHEN 5 THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)
        WHEN 6 THEN year(o_orderdate) || '13'
        ELSE '' END
"""


@query(
    f"""
    WITH dated AS (SELECT o_orderkey, o_orderdate, {_DATE_SQL} AS cell FROM orders),
    parts AS (
        SELECT *, regexp_extract(cell, '^\\D*(\\d{{4}})\\D{{1,3}}(\\d{{1,2}})(\\D|$)', 1) AS y1,
               lpad(regexp_extract(cell, '^\\D*(\\d{{4}})\\D{{1,3}}(\\d{{1,2}})(\\D|$)', 2), 2, '0') AS m1,
               regexp_extract(cell, '^\\D*(\\d{{4}})(\\d{{2}})', 1) AS y2,
               regexp_extract(cell, '^\\D*(\\d{{4}})(\\d{{2}})', 2) AS m2 FROM dated),
    found AS (
        SELECT o_orderkey, o_orderdate, CASE
            WHEN y1 <> '' THEN CASE WHEN m1 BETWEEN '01' AND '12' THEN y1 || m1 END
            WHEN m2 BETWEEN '01' AND '12' THEN y2 || m2 END AS period FROM parts)
    SELECT o_orderkey, period, strftime(o_orderdate, '%Y%m') AS typed_period,
           strftime(strptime(period || '01', '%Y%m%d') + INTERVAL 1 MONTH, '%Y%m') AS next_period,
           strftime(strptime(period || '01', '%Y%m%d') - INTERVAL 14 MONTH, '%Y%m') AS far_period
    FROM found"""
)
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting periods of typed dates and of date texts, and period arithmetic."""
    day = F.col("o_orderdate")
    year, month, dom = (f(day).cast("string") for f in (F.year, F.month, F.dayofmonth))
    kind = F.col("o_orderkey") % 8
    cell = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "yyyyMMdd"))
        .when(kind == 2, F.date_format(day, "yyyyMM"))
        .when(kind == 3, F.date_format(day, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 4, F.concat(year, F.lit("年"), month, F.lit("月"), dom, F.lit("日")))
        .when(kind == 5, F.concat_ws("-", year, month, dom))
        .when(kind == 6, F.concat(year, F.lit("13")))
        .otherwise(F.lit(""))
    )
    period = values.period_of(cell)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        period.alias("period"),
        values.period_of_date(day).alias("typed_period"),
        values.shift_period(period, 1).alias("next_period"),
        values.shift_period(period, -14).alias("far_period"),
    )


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period,
           strftime(o_orderdate, '%Y%m') = '199904' AS in_period,
           strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y%m') AS shifted,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS number,
           trim(o_orderpriority) = '' AS blank
    FROM orders"""
)
def helper_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition helpers called from Spark SQL text."""
    install_sql_helpers(spark)
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "period_of(cast(o_orderdate as string)) as period",
        "period_of(cast(o_orderdate as string)) = '199904' as in_period",
        "shift_period(period_of(cast(o_orderdate as string)), 2) as shifted",
        "cast(as_number(cast(cast(o_totalprice as decimal(18,2)) as string)) as double) as number",
        "not has_value(o_orderpriority) as blank",
    )


_KEY_SQL = """
    CASE c_custkey % 7
        WHEN 0 THEN '00' || CAST(c_custkey AS VARCHAR)
        WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.50'
        WHEN 2 THEN ' （' || c_name || '） '
        WHEN 3 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)
        WHEN 4 THEN '9007199254740993' || CAST(c_custkey AS VARCHAR)
        WHEN 5 THEN '   '
        ELSE '1,234.' || CAST(c_custkey AS VARCHAR) END
"""


@query(
    f"""
    WITH raw AS (SELECT c_custkey, {_KEY_SQL} AS cell FROM customer),
    bare AS (SELECT c_custkey, cell, nullif(trim(cell), '') AS t FROM raw),
    num AS (SELECT *, translate(t, '（）', '()') AS shown,
                   TRY_CAST(replace(t, ',', '') AS DECIMAL(38,6)) AS n FROM bare)
    SELECT c_custkey, shown AS display,
           coalesce(regexp_replace(CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', ''), shown)
               AS key_text,
           coalesce(CAST(CAST(round(n, 2) AS DECIMAL(38,2)) AS VARCHAR), shown) AS scalar_text
    FROM num"""
)
def comparison_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display text, key form and scalar form of messy ids and amounts."""
    key = F.col("c_custkey")
    id_text = key.cast("string")
    kind = key % 7
    cell = (
        F.when(kind == 0, F.concat(F.lit("00"), id_text))
        .when(kind == 1, F.concat(id_text, F.lit(".50")))
        .when(kind == 2, F.concat(F.lit(" （"), F.col("c_name"), F.lit("） ")))
        .when(kind == 3, money_text("c_acctbal"))
        .when(kind == 4, F.concat(F.lit("9007199254740993"), id_text))
        .when(kind == 5, F.lit("   "))
        .otherwise(F.concat(F.lit("1,234."), id_text))
    )
    cells = table(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell"))
    return cells.select(
        "c_custkey",
        values.display_text(values.blank_to_null(F.col("cell"))).alias("display"),
        values.canon_key(F.col("cell")).alias("key_text"),
        values.canon_scalar(F.col("cell")).alias("scalar_text"),
    )


@query(
    """
    WITH raw AS (
        SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, props FROM events)
    SELECT event_id,
           CASE event_id % 7 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN event_type
                WHEN 2 THEN CAST(k AS VARCHAR) WHEN 3 THEN event_type WHEN 4 THEN NULL
                WHEN 5 THEN event_type ELSE props END AS flat,
           CASE event_id % 7 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN event_type
                WHEN 2 THEN CAST(k AS VARCHAR) WHEN 3 THEN event_type WHEN 4 THEN NULL
                WHEN 5 THEN event_type ELSE props END AS config_text,
           CASE event_id % 7 WHEN 0 THEN FALSE WHEN 2 THEN k <> 0 ELSE FALSE END AS flag
    FROM raw"""
)
def wrapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars inside wrapped JSON values, as target fields and configuration cells hold them."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 7
    name = F.col("event_type")
    cell = (
        F.when(kind == 0, F.concat(F.lit('{"type":2,"value":['), k, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('[{"text":"'), name, F.lit('","type":"text"}]')))
        .when(kind == 2, k)
        .when(kind == 3, name)
        .when(kind == 4, F.lit("[]"))
        .when(kind == 5, F.concat(F.lit('{"value":[{"text":"'), name, F.lit('"}]}')))
        .otherwise(F.col("props"))
    )
    cells = table(spark, sf_dir, "events").select("event_id", cell.alias("cell"))
    return cells.select(
        "event_id",
        nested.unwrap(F.col("cell")).alias("flat"),
        nested.first_text(F.col("cell")).alias("config_text"),
        nested.flag(F.col("cell")).alias("flag"),
    )


@query(
    """
    WITH raw AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                        CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS v FROM events)
    SELECT event_id,
           CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN k WHEN 2 THEN k ELSE NULL END AS input,
           CASE event_id % 4 WHEN 0 THEN CAST(trunc(v) AS BIGINT) ELSE NULL END AS output,
           CASE WHEN event_id % 4 = 3 THEN k END AS total
    FROM raw"""
)
def token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counters of usage objects that name them differently or hold other types."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    user, value = F.col("user_id").cast("string"), money_text("value")
    usage = (
        F.when(
            kind == 0,
            F.concat(F.lit('{"inputTokens":'), user, F.lit(',"output_tokens":'), value, F.lit("}")),
        )
        .when(kind == 1, F.concat(F.lit('{"inputTokens":true,"prompt_tokens":'), k, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"inputTokens":"7","input_tokens":'), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"total_tokens":'), k, F.lit("}")))
    )
    events = table(spark, sf_dir, "events").select("event_id", usage.alias("usage"))
    counters = nested.token_counters(F.col("usage"))
    return events.select("event_id", *[c.alias(name) for name, c in counters.items()])


@query(
    """
    WITH ids AS (
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_brand, '#', '-')
            WHEN 2 THEN ' ' || p_type || '.v' || p_size || ' ' WHEN 3 THEN '../' || p_type
            ELSE p_type || '..x' END AS raw, p_name, p_brand FROM part)
    SELECT p_partkey,
           regexp_full_match(trim(raw), '[A-Za-z0-9][A-Za-z0-9_.-]*') AND NOT contains(raw, '..') AS safe,
           coalesce(nullif(lower(trim(regexp_replace(trim(p_name), '[^a-zA-Z0-9_-]+', '-', 'g'), '-')), ''),
                    'unnamed') AS slug,
           '202605_' || regexp_replace(p_brand, '[^\\p{L}\\p{N}_-]', '_', 'g') || '_20260607-123456' AS artifact
    FROM ids"""
)
def ids_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe-id test, slugs and artifact names."""
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    raw = (
        F.when(kind == 0, F.col("p_brand"))
        .when(kind == 1, F.replace("p_brand", F.lit("#"), F.lit("-")))
        .when(kind == 2, F.concat(F.lit(" "), "p_type", F.lit(".v"), size, F.lit(" ")))
        .when(kind == 3, F.concat(F.lit("../"), "p_type"))
        .otherwise(F.concat("p_type", F.lit("..x")))
    )
    made_at = F.lit("2026-06-07 12:34:56").cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.is_safe_id(raw).alias("safe"),
        text.slug(F.col("p_name")).alias("slug"),
        text.artifact_name(F.lit("202605"), F.col("p_brand"), made_at).alias("artifact"),
    )


@query(
    """
    WITH measured AS (
        SELECT doc_id, lang, regexp_matches(text, '[�ÃÂéæ]') AS marked,
               length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk,
               length(regexp_replace(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS visible
        FROM documents)
    SELECT lang, count(*) AS documents, count(*) FILTER (WHERE marked) AS marked,
           CAST(sum(visible) AS BIGINT) AS visible_chars, CAST(sum(cjk) AS BIGINT) AS cjk_chars,
           max(CASE WHEN visible > 0 THEN cjk / visible ELSE 0.0 END) AS max_cjk_ratio
    FROM measured GROUP BY lang"""
)
def encoding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding markers and CJK share of whole document texts, per language."""
    body = F.col("text")
    measured = table(spark, sf_dir, "documents").select(
        "lang",
        text.has_encoding_marker(body).alias("marker"),
        text.visible_length(body).alias("visible"),
        text.cjk_length(body).alias("cjk"),
    )
    ratio = F.when(F.col("visible") > 0, F.col("cjk") / F.col("visible")).otherwise(F.lit(0.0))
    return measured.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count_if("marker").alias("marked"),
        F.sum("visible").alias("visible_chars"),
        F.sum("cjk").alias("cjk_chars"),
        F.max(ratio).alias("max_cjk_ratio"),
    )


def _intent_sql(word: str) -> str:
    # Written out on purpose, so that the check does not share the patterns of the code.
    wordings = [
        rf"\b(?:do\s+not|don''t|not|no|without)\s+(?:(?:run|execute|perform|call|trigger|do)\s+)?(?:the\s+)?{word}\b",
        rf"\b{word}\s+(?:(?:was|is|should\s+be)\s+)?not\s+(?:run|executed|performed|called|triggered|done)\b",
        rf"(?:不要|不|禁止|未)(?:执行|运行|调用|触发|跑|做)?\s*(?:\b{word}\b|上传)",
        rf"(?:\b{word}\b|上传)\s*不(?:执行|运行|调用|触发|跑|做)?",
    ]
    cleaned = "lower(text)"
    for pattern in wordings:
        cleaned = f"regexp_replace({cleaned}, '{pattern}', ' ', 'g')"
    return f"""
    SELECT conv_id, turn, regexp_matches(cleaned, '\\b{word}\\b') OR contains(cleaned, '上传') AS asks
    FROM (SELECT conv_id, turn, {cleaned} AS cleaned FROM conversations)"""


@query(_intent_sql("the"))
def action_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages ask for an action, with wordings that forbid it taken out first."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.asks_for(F.col("text"), word="the").alias("asks")
    )
