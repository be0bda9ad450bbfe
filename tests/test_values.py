"""Cell values, wrapped values and text measures on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import nested, text, values


def each(spark, cells, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(cells)), f"i int, v {kind}")
    found = rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()
    return [row["x"] for row in found]


def numbers(found):
    return [None if x is None else float(x) for x in found]


def test_blank(spark):
    cells = [None, "", " \t", "　", "x", " 0 "]
    assert each(spark, cells, values.is_blank) == [True] * 4 + [False] * 2
    assert each(spark, cells, values.has_value) == [False] * 4 + [True] * 2


def test_numbers(spark):
    cells = ["12.5", "`157.80 ", "-", "—", "－–", "1,234.5", "", None, "1e3"]
    expected = [12.5, 157.8, 0.0, 0.0, 0.0, 1234.5, None, None, 1000.0]
    assert numbers(each(spark, cells, values.as_number)) == expected


@pytest.mark.parametrize("cell", ["1.0d", "1f", "NaN", "inf", "12%", "abc"])
def test_unreadable_numbers(spark, cell):
    assert each(spark, [cell], values.as_number_invalid) == [True]
    assert each(spark, [cell], values.sum_unreadable) == [True]
    assert each(spark, [cell], values.as_number) == [None]


def test_sum_cells(spark):
    cells = ["", None, "  ", "`157.80 ", "-"]
    optional = each(spark, cells, lambda v: values.sum_value(v, True))
    assert numbers(optional) == [0.0, 0.0, 0.0, 157.8, 0.0]
    assert each(spark, cells, values.sum_empty) == [True, True, True, False, False]


def test_periods(spark):
    cells = ["2026-11-5", "2026-1-5", "2026年5月3日", "202613", "20260503", "2026/05", "", None, "x"]
    expected = ["202611", "202601", "202605", None, "202605", "202605", None, None, None]
    assert each(spark, cells, values.period_of) == expected
    as_sql = each(spark, cells, lambda v: F.expr("period_of(v)"))
    assert as_sql == expected


def test_period_shift(spark):
    moved = each(spark, ["202612", "202601"], lambda v: values.shift_period(v, 1))
    assert moved == ["202701", "202602"]
    moved = each(spark, ["202601", "bad"], lambda v: values.shift_period(v, -13))
    assert moved == ["202412", None]


def test_sql_helpers_agree_with_columns(spark):
    cells = ["12.5", "`1,0 ", "-——", "", None, "　", "12%", "9", "2026-1-5", "`"]
    for name in ("is_blank", "has_value", "as_number", "period_of"):
        mine = each(spark, cells, getattr(values, name))
        assert each(spark, cells, lambda v, n=name: F.expr(f"{n}(v)")) == mine, name


def test_key_form(spark):
    cells = ["（积玉桥店）", "(积玉桥店)", "25455.50", "00123", "123.0", " ", "-0.00"]
    expected = ["(积玉桥店)", "(积玉桥店)", "25455.5", "123", "123", None, "0"]
    assert each(spark, cells, values.canon_key) == expected
    long_ids = ["9007199254740993", "9007199254740992"]
    assert each(spark, long_ids, values.canon_key) == long_ids


def test_scalar_form(spark):
    cells = ["12.3456", " 8,651.93 ", "  ", "-148.07", "a（b）"]
    assert each(spark, cells, values.canon_scalar) == ["12.35", "8651.93", None, "-148.07", "a(b)"]


def test_outbound(spark):
    typed = each(spark, ["202605", "12.50", " ", "x"], lambda v: values.typed_for_target(v, 2))
    assert numbers(typed) == [202605.0, 12.5, None, None]
    assert each(spark, ["12.50"], lambda v: values.typed_for_target(v, 1)) == ["12.50"]


def test_unwrap(spark):
    cells = {
        '{"type":2,"value":[202605]}': "202605",
        '[{"text":"MD00105","type":"text"}]': "MD00105",
        "20452.18": "20452.18",
        "plain": "plain",
        "[]": None,
        '{"type":1,"value":[]}': None,
        '{"value":null}': None,
        "null": None,
        '["x","y"]': '["x","y"]',
        '{"value":{"text":"[1]"}}': "[1]",
        '[{"value":[{"text":"deep"}]}]': "deep",
        '[[[[[[{"text":"six"}]]]]]]': "six",
        '{"value":[{"value":[{"value":[{"value":[{"text":"eight"}]}]}]}]}': "eight",
        "[" * 40 + "7" + "]" * 40: "7",
        '{"a":1}': '{"a":1}',
        "[已结算]": "[已结算]",
        '[{"text":"a"},{"text":"b"}]': '["a","b"]',
        '{"a":{"text":"q"}}': '{"a":"q"}',
        '[{"value":[1]}, [], ["x"], {"b":[{"text":"é"}], "a":{"value":[1,[2]]}}]': '[1,null,"x",{"a":[1,2],"b":"é"}]',
        '{"text":{"value":1}}': '{"value":1}',
        '{"text":null,"value":5}': None,
        '{"text":["a"]}': '["a"]',
        '{ "k": 69 }': '{ "k": 69 }',
        "{}": "{}",
        '"quoted"': "quoted",
        '[true]': "true",
        '{"value":{"a\\"b":[{"text":"x"},2]}}': '{"a\\"b":["x",2]}',
        "[" * 30 + '[{"text":"a"},{"value":[[["b"]]]}]' + "]" * 30: '["a","b"]',
    }
    assert each(spark, list(cells), nested.unwrap) == list(cells.values())


def test_first_text(spark):
    cells = {
        " a ": "a",
        "  ": None,
        '[{"text":"x"}]': "x",
        '["", "y"]': "y",
        '{"name":"n"}': "n",
        '{"text":" ","value":"v"}': "v",
        '[[[[[[{"text":"six"}]]]]]]': "six",
        '[{"value":[{"value":[{"value":[{"name":"n"}]}]}]}]': "n",
        "[]": None,
    }
    assert each(spark, list(cells), nested.first_text) == list(cells.values())


def test_flags(spark):
    cells = ["true", "YES", " y ", "1", "0", "no", "", None, "2"]
    assert each(spark, cells, nested.flag) == [True] * 4 + [False] * 4 + [True]


def test_token_counters(spark):
    cells = [
        '{"inputTokens":true,"prompt_tokens":7}',
        '{"input_tokens":7.9}',
        '{"inputTokens":"7"}',
        "{}",
        None,
    ]
    found = each(spark, cells, lambda v: nested.token_counters(v)["input"])
    assert found == [7, 7, None, None, None]


def test_names(spark):
    assert each(spark, ["wechat/pay:settlement"], text.safe_stem) == ["wechat_pay_settlement"]
    assert each(spark, [" A b!c ", "???", ""], text.slug) == ["a-b-c", "unnamed", "unnamed"]
    cells = ["case-1", " case.2 ", "a..b", "../x", "", None, "-a", "a/b"]
    assert each(spark, cells, text.is_safe_id) == [True, True] + [False] * 6


def test_intent(spark):
    cells = [
        "Do not run upload.",
        "Do it and then upload the result.",
        "no upload please",
        "不要上传",
        "请上传文件",
        "Upload was not executed",
    ]
    assert each(spark, cells, text.asks_for) == [False, True, False, False, True, False]


def test_encoding_measures(spark):
    assert each(spark, ["一二ab", "  ", "abcd"], text.cjk_ratio) == [0.5, 0.0, 0.0]
    assert each(spark, ["plain", "café", "�"], text.has_encoding_marker) == [
        False,
        True,
        True,
    ]


def test_split_numbers_are_exact(spark):
    cells = [0.29, -0.29, 1.1, 2.675, 123456.789, 999999999.99, 12345678901.23, -5e12 + 0.25, 0.0]
    expected = [f"{x:.6f}" for x in cells[:-2]] + ["-4999999999999.750000", "0.000000"]

    def parts(v):
        return values.split_number(v, values.large_number(v))

    joined = each(spark, cells, lambda v: values.joined_number(*parts(v)), kind="double")
    assert [str(x) if x else "0.000000" for x in joined] == expected
    lost = each(
        spark,
        [float("nan"), float("inf"), 1e300, None],
        lambda v: parts(v)[0],
        kind="double",
    )
    assert lost == [None] * 4
