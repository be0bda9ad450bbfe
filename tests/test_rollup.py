"""Conditions, rollup, issues and backfill on literal fixtures and on random ones."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.errors import ConditionError, RollupIssues, RuleError
from ledgerspark.functions import conditions
from ledgerspark.operators.backfill import fill_unique, merge_groups
from ledgerspark.plans import rules as R
from ledgerspark.plans.rollup import plan_rollup, table_input
from ledgerspark.plans.rules import Rule, RuleBundle, SheetSpec


def bundle(*rules, sheet="DEFAULT"):
    return RuleBundle("p", (SheetSpec(sheet),), rules)


def group(name, **more):
    return Rule(name, R.GROUP, "DEFAULT", name, **more)


def total(name, **more):
    return Rule(more.pop("output", name), R.SUM, "DEFAULT", name, **more)


def roll(frame, *rules, period="202605", **more):
    return plan_rollup({"DEFAULT": table_input(frame, **more)}, bundle(*rules), period)


@pytest.fixture(scope="module")
def one_row(spark):
    return spark.createDataFrame(
        [("索赔单", "12.5", datetime.datetime(2026, 3, 20, 12, 30), "10.00", None, "x")],
        "`订单类型` string, `金额` string, `结算时间` timestamp, rmb string, empty string, bad string",
    )


PLACES = {"rmb": ("实收组成", "人民币")}


@pytest.mark.parametrize(
    "condition, period, expected",
    [
        (lambda f: f("订单类型") == "索赔单", "202605", True),
        (lambda f: f.period_of(f("结算时间")) == f.current_period, "202603", True),
        (lambda f: f.period_of(f("结算时间")) == f.add_months(f.current_period, 1), "202602", True),
        (lambda f: f.as_number(f("实收组成_人民币")) == 10, "202605", True),
        (lambda f: f("empty") == "x", "202605", False),
        (lambda f: f("empty") != "x", "202605", True),
        (lambda f: f("empty").isin("x", "y"), "202605", False),
        (lambda f: f("bad") == 5, "202605", False),
        (lambda f: f("bad") != 5, "202605", True),
        (lambda f: f("bad").isin(5, 6), "202605", False),
        (lambda f: f("empty").isin("x", None), "202605", True),
        (lambda f: ~f.is_blank(f("empty")), "202605", False),
        (lambda f: f.as_number(f("金额")) % 5 == 2.5, "202605", True),
        (lambda f: (f("订单类型") == "no") & (f.as_number(f("bad")) > 1), "202605", False),
        (lambda f: (f("订单类型") == "索赔单") | (f.as_number(f("bad")) > 1), "202605", True),
        ("`订单类型` <=> '索赔单'", "202605", True),
        ("period_of(`结算时间`) = shift_period(current_period, 1)", "202602", True),
        ("`订单类型` <> '索赔单' and as_number(`bad`) > 1", "202605", False),
        ("`empty` = 'x'", "202605", False),
        ("`bad` = 5", "202605", False),
        ('F("订单类型") == "索赔单" and period_of(F("结算时间")) == add_months(current_period, 1)', "202602", True),
        (lambda f: f.period_of(f("结算时间")) == 202603, "202605", False),
        (lambda f: f.as_number(f("金额")) == "x", "202605", False),
        (lambda f: f("bad") + f("bad") == "xx", "202605", True),
        (lambda f: f("bad"), "202605", True),
        ("as_number(`金额`)", "202605", True),
    ],
)
def test_conditions(one_row, condition, period, expected):
    plan = roll(
        one_row, total("金额", condition=condition), period=period, categories=PLACES
    )
    assert plan.issues().isEmpty()
    assert float(plan.result().first()["金额"]) == (12.5 if expected else 0.0)


@pytest.mark.parametrize(
    "condition",
    [
        lambda f: f.as_number(f("bad")) == 1,
        lambda f: f("empty") > "a",
        lambda f: f.as_number(f("empty")) > 1,
        lambda f: f.as_number(f("金额")) / 0 > 1,
        lambda f: (f("订单类型") == "索赔单") & (f.as_number(f("bad")) > 1),
        lambda f: f("bad") > 1,
        lambda f: f("金额") + 1 > 0,
        "as_number(`bad`) > 1",
        "`bad` > 5",
        'F("金额") + 1 > 0',
        lambda f: -f("bad") == 1,
    ],
)
def test_conditions_that_cannot_be_decided(one_row, condition):
    issues = roll(one_row, total("金额", condition=condition)).issues().collect()
    assert [row["message"] for row in issues] == ["The condition could not be evaluated."]


@pytest.mark.parametrize(
    "condition, code",
    [
        ("CONDITION", conditions.CODE_PLACEHOLDER),
        (" condition ", conditions.CODE_PLACEHOLDER),
        (lambda f: f(3) == "x", conditions.CODE_FIELD_CALL),
        (lambda f: f("不存在字段") == "foo", conditions.CODE_UNRESOLVED),
        ("`不存在字段` = 'foo'", conditions.CODE_UNRESOLVED),
        (lambda f: f("金额") == "1" and f("金额") == "2", conditions.CODE_PARSE),
        (lambda f: True, conditions.CODE_PARSE),
        ('F(金额) == "x"', conditions.CODE_FIELD_CALL),
        ("reflect('java.lang.Math', 'abs', 1) = '1'", conditions.CODE_FUNCTION),
        ("rand() < 0.5", conditions.CODE_FUNCTION),
        ("`金额` = '1' or /*'*/ rand() < 1 /*'*/", conditions.CODE_SYNTAX),
        ("`金额` = '1' --'", conditions.CODE_SYNTAX),
        ("金额 <=> '1'", conditions.CODE_SYNTAX),
        ("exists (select 1)", conditions.CODE_FUNCTION),
        ("`金额` in (select 1)", conditions.CODE_SYNTAX),
        (r"`金额` = r'\' or rand() < 1 or ''", conditions.CODE_SYNTAX),
    ],
)
def test_broken_conditions(one_row, condition, code):
    given = table_input(one_row)

    def lookup(name):
        found = given.by_name(name)
        if not found:
            raise ConditionError(conditions.CODE_UNRESOLVED, "unknown", name)
        return conditions.Term(found[0].column)

    with pytest.raises(ConditionError) as caught:
        conditions.build(condition, lookup, "202605")
    assert caught.value.code == code


@pytest.mark.parametrize(
    "text, code",
    [
        ("`a` = = 'x'", conditions.CODE_PARSE),
        ("F('a') == ", conditions.CODE_PARSE),
        ("(" * 5000 + "F('a')", conditions.CODE_PARSE),
        ("nope(`a`)", conditions.CODE_FUNCTION),
        ("F('a').upper() == 'x'", conditions.CODE_FUNCTION),
        ("__import__('os') or F('a')", conditions.CODE_FUNCTION),
        ("F('b') == 'x'", conditions.CODE_UNRESOLVED),
        ("a == F('a')", conditions.CODE_UNRESOLVED),
        ("F(a) == 'x'", conditions.CODE_FIELD_CALL),
        ("F('a', 'b') == 'x'", conditions.CODE_FIELD_CALL),
        ("`` = 'x'", conditions.CODE_FIELD_CALL),
        ("`a` || 'x'", conditions.CODE_SYNTAX),
        ("F('a')[0] == 'x'", conditions.CODE_SYNTAX),
        ("F('a') == b'x'", conditions.CODE_SYNTAX),
        ("F('a') if F('a') else 1", conditions.CODE_SYNTAX),
        ("F('a') ** 2 > 1", conditions.CODE_SYNTAX),
        ("is_blank(F('a'), 1)", conditions.CODE_RUNTIME),
    ],
)
def test_text_that_is_no_condition(spark, text, code):
    given = table_input(spark.createDataFrame([], "a string"))

    def lookup(name):
        found = given.by_name(name)
        if not found:
            raise ConditionError(conditions.CODE_UNRESOLVED, "unknown", name)
        return conditions.Term(found[0].column, kind=found[0].kind)

    with pytest.raises(ConditionError) as caught:
        conditions.build(text, lookup, "202605")
    assert caught.value.code == code


TYPED = "t string, e string, z string, n decimal(10,2), d double, i int, b boolean, w timestamp, zero int, period string"


def outcomes(spark, texts):
    """Outcome per condition on one row: True, False, or None where it is an issue of the row."""
    from datetime import datetime

    row = ("abc", "", None, 12.5, 2.5, 202605, True, datetime(2026, 3, 20, 12, 30), 0, "202605")
    from decimal import Decimal

    frame = spark.createDataFrame([(*row[:3], Decimal("12.50"), *row[4:])], TYPED)
    given = table_input(frame)

    def lookup(name):
        (found,) = given.by_name(name)
        return conditions.Term(found.column, kind=found.kind)

    terms = [conditions.build(x, lookup, "202603") for x in texts]
    found = frame.select(
        *[F.when(F.lit(False) if x.bad is None else x.bad, None).otherwise(x.value).alias(f"c{i}") for i, x in enumerate(terms)]
    ).first()
    return list(found)


def by_python(text):
    """The same condition run by Python on the same row."""
    from datetime import datetime
    from decimal import Decimal

    row = {
        "t": "abc", "e": "", "z": None, "n": Decimal("12.50"), "d": 2.5, "i": 202605, "b": True,
        "w": datetime(2026, 3, 20, 12, 30), "zero": 0, "period": "202605",
    }

    def as_number(v):
        return None if v is None or v == "" else Decimal(str(v))

    def period_of(v):
        return v.strftime("%Y%m") if isinstance(v, datetime) else (v if v and v.isdigit() else None)

    names = {
        "F": row.__getitem__, "as_number": as_number, "period_of": period_of, "current_period": "202603",
        "is_blank": lambda v: v is None or v == "", "has_value": lambda v: not (v is None or v == ""),
    }
    try:
        return bool(eval(text, {"__builtins__": {}}, names))  # noqa: S307
    except Exception:
        return None


EXPRESSIONS = [
    'F("z") == "x"', 'F("z") != "x"', 'F("z") == None', 'F("z") is None', 'F("t") is not None', 'F("t") == 5', 'F("t") != 5',
    'F("t") > 5', 'F("t") > "abb"', 'F("z") > "a"', 'period_of(F("w")) == 202603', 'period_of(F("w")) == "202603"',
    'period_of(F("w")) == current_period', 'as_number(F("period")) == "x"', 'as_number(F("period")) == 202605', 'as_number(F("z")) > 1',
    '-F("t") == 1', '-F("d") < 0', '+F("t") == 1', 'F("t") + F("t") == "abcabc"', 'F("t") + F("n") == 1', 'F("n") + 1 == 13.5',
    'F("n") - F("i") < 0', 'F("d") * 2 == 5', 'F("d") / F("zero") > 1', 'F("i") % 5 == 0', '-F("i") % 7 == 0', 'F("z") + 1 > 0',
    'F("t")', 'F("e")', 'F("z")', 'F("n")', 'F("zero")', 'F("b")', 'F("w")', 'not F("t")', 'not F("zero")', 'F("t") and F("zero")',
    'F("e") or F("n")', 'F("zero") and F("t") > 5', 'F("b") or F("t") > 5', 'F("b") and F("t") > 5', 'F("b") == 1', 'F("b") + 1 == 2',
    'F("t") in ["x", "abc"]', 'F("t") in ("x",)', 'F("t") not in {"x", 5}', 'F("i") in [202605, "abc"]', 'F("z") in [None]', 'F("z") in ["a"]',
    'F("b") in [1]', '"b" in F("t")', '"x" in F("t")', '"x" in F("z")', '5 in F("t")', 'F("w") == "2026-03-20"', 'F("w") > "2026"', 'F("w") == F("w")',
    '1 < F("d") < 3', '1 < F("d") < 2', 'F("zero") < 1 < F("t")', '3 < F("d") < F("t")', 'is_blank(F("e")) == True', 'is_blank(F("z")) and has_value(F("t"))',
    'not is_blank(F("t")) or F("t") > 1', '(F("t") == "abc") == True', 'F("n") == 12.5', 'F("i") == 202605.0', 'True', 'None', '"" or 0', '1 == 1',
]


def test_conditions_are_those_of_python(spark):
    assert dict(zip(EXPRESSIONS, outcomes(spark, EXPRESSIONS), strict=True)) == {x: by_python(x) for x in EXPRESSIONS}


def test_sql_spelling_gives_the_same_terms(spark):
    pairs = {
        "`z` = 'x'": 'F("z") == "x"', "`z` <=> null": 'F("z") == None', "`t` = 5": 'F("t") == 5', "`t` <> 'x'": 'F("t") != "x"',
        "`z` is null and `t` is not null": 'F("z") is None and F("t") is not None', "`t` in ('x', 'abc')": 'F("t") in ["x", "abc"]',
        "`t` not in ('abc')": 'F("t") not in ["abc"]', "NOT (`t` = 'abc') OR `zero` = 00": 'not (F("t") == "abc") or F("zero") == 0',
        "`t` = 'a''b'": "F(\"t\") == \"a'b\"", "`t` > 5": 'F("t") > 5', "-`t` = 1": '-F("t") == 1', "as_number(`period`) = 'x'": 'as_number(F("period")) == "x"',
        "`t`": 'F("t")', "`zero`": 'F("zero")', "period_of(`w`) = current_period": 'period_of(F("w")) == current_period',
        "(`d` + 1) * 2 >= 7 and `i` % 5 = 0": '(F("d") + 1) * 2 >= 7 and F("i") % 5 == 0',
    }
    assert dict(zip(pairs, outcomes(spark, list(pairs)), strict=True)) == {k: by_python(v) for k, v in pairs.items()}


def test_groups_stay_when_no_row_qualifies(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "k string, v string")
    plan = roll(rows, group("k"), total("v", condition=lambda f: f("k") == "b"))
    found = {row["k"]: float(row["v"]) for row in plan.release().collect()}
    assert found == {"a": 0.0, "b": 3.0}


def test_bad_amount_outside_the_condition_is_no_issue(spark):
    rows = spark.createDataFrame([("a", "bad"), ("b", "3")], "k string, v string")
    plan = roll(rows, group("k"), total("v", condition=lambda f: f("k") == "b"))
    assert plan.issues().isEmpty()


def test_issues_stop_the_release(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "x%"), ("c", "1")], "k string, v string")
    with pytest.raises(RollupIssues) as caught:
        roll(rows, group("k"), total("v")).release()
    messages = sorted(row["message"] for row in caught.value.report.collect())
    assert messages == ["SUM field 'v' is empty.", "SUM field 'v' is not a number."]
    assert caught.value.count == 2


def test_missing_required_column(spark):
    rows = spark.createDataFrame([("a", "1")], "k string, v string")
    with pytest.raises(RollupIssues) as caught:
        roll(rows, group("k"), total("nothing")).release()
    assert [r["message"] for r in caught.value.report.collect()] == ["Required field is missing."]


def test_shared_sum_output_is_refused(spark):
    rows = spark.createDataFrame([("a", "1", "2")], "k string, v string, w string")
    with pytest.raises(RuleError):
        roll(rows, group("k"), total("v", output="x"), total("w", output="x"))


def test_first_group_rule_wins(spark):
    rows = spark.createDataFrame([("a", "b", "1")], "k string, l string, v string")
    rules = (group("k"), Rule("k", R.GROUP, "DEFAULT", "l"), total("v"))
    assert roll(rows, *rules).release().first()["k"] == "a"


def test_patch_adds_a_rule():
    book = R.PatchBook()
    book.register("p", R.add_rule(group("extra")))
    assert book.apply(bundle(group("k"))).group_fields == ["k", "extra"]
    assert book.apply(RuleBundle("other", (), ())).group_fields == []


def test_names_may_be_any_text(spark):
    rows = spark.createDataFrame([("a", "1.5")], "`k.e``y 店` string, `v (元)` string")
    plan = roll(rows, group("k.e`y 店"), total("v (元)"))
    assert plan.release().columns == ["period", "k.e`y 店", "v (元)"]


def test_backfill_fixture(spark):
    rows = spark.createDataFrame(
        [
            ("10004", "蔡林记襄阳白马广场店", "武汉", "62114.3", "152.5", "157.58"),
            (None, "蔡林记襄阳白马广场店", "武汉", "4.0", "0.0", "0.01"),
        ],
        "id string, shop string, src string, a string, b string, c string",
    )
    rules = [group(n) for n in ("id", "shop", "src")] + [total(n) for n in "abc"]
    found = [tuple(row) for row in roll(rows, *rules).release().collect()]
    money = tuple(Decimal(x) for x in ("62118.30", "152.50", "157.59"))
    assert found == [("202605", "10004", "蔡林记襄阳白马广场店", "武汉", *money)]


def filled(spark, groups):
    rows = spark.createDataFrame([(*g, 1) for g in groups], "x string, y string, z string, n int")
    done = merge_groups(fill_unique(rows, ["x", "y", "z"]), ["x", "y", "z"], ["n"])
    return {(row["x"], row["y"], row["z"]): row["n"] for row in done.collect()}


def test_backfill_leaves_two_candidates_alone(spark):
    found = filled(spark, [("1", "a", "s"), ("2", "a", "s"), (None, "a", "s")])
    assert found == {("1", "a", "s"): 1, ("2", "a", "s"): 1, (None, "a", "s"): 1}


def test_backfill_is_one_pass_in_field_order(spark):
    groups = [(None, None, "z"), ("1", None, "z"), ("3", None, "z"), ("1", "2", "z")]
    found = filled(spark, groups)
    assert found == {(None, None, "z"): 1, ("1", "2", "z"): 2, ("3", None, "z"): 1}


def test_backfill_of_two_gaps_in_one_row(spark):
    groups = [("1", None, "z"), (None, None, "z"), ("1", "2", "z")]
    assert filled(spark, groups) == {("1", "2", "z"): 3}


def test_backfill_of_a_single_field(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    done = merge_groups(fill_unique(rows, ["x"]), ["x"], ["n"]).collect()
    assert [tuple(row) for row in done] == [("a", 3)]


def brute_backfill(groups):
    """One pass per field over plain tuples."""
    rows = [list(g) for g in groups]
    for i in range(3):
        others = [j for j in range(3) if j != i]
        known = {}
        for row in rows:
            if row[i] is not None:
                known.setdefault(tuple(row[j] for j in others), set()).add(row[i])
        for row in rows:
            options = known.get(tuple(row[j] for j in others), set())
            if row[i] is None and len(options) == 1:
                row[i] = next(iter(options))
    counts = {}
    for row in rows:
        counts[tuple(row)] = counts.get(tuple(row), 0) + 1
    return counts


@pytest.mark.parametrize("seed", range(4))
def test_backfill_against_brute_force(spark, seed):
    dice = random.Random(seed)
    options = [None, "1", "2", "3"]
    groups = sorted({tuple(dice.choice(options) for _ in range(3)) for _ in range(25)}, key=str)
    found = filled(spark, groups)
    assert found == brute_backfill(groups)
    assert sum(found.values()) == len(groups)


def test_row_order_and_partitions_do_not_matter(spark):
    dice = random.Random(7)
    data = [
        (dice.choice(["a", "b", None]), dice.choice(["x", "y", ""]), f"{dice.random():.4f}")
        for _ in range(300)
    ]
    rules = (group("k"), group("l"), total("v"))
    results = []
    for partitions in (1, 7):
        dice.shuffle(data)
        rows = spark.createDataFrame(data, "k string, l string, v string").repartition(partitions)
        done = roll(rows, *rules).release(backfill=False).collect()
        results.append({(r["k"], r["l"]): r["v"] for r in done})
    assert results[0] == results[1]


def test_large_integers_add_up(spark):
    rows = spark.createDataFrame([("a", 9 * 10**18)] * 3, "k string, v bigint")
    assert int(roll(rows, group("k"), total("v")).release().first()["v"]) == 27 * 10**18


def test_doubles_of_any_size_add_up_as_decimals_do(spark):
    """One rounding rule, whether a sum is of doubles alone or another sheet feeds it text."""
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    rng = np.random.default_rng(1)
    values = [999999999.0000005, 1000000000.0000005, 0.0000005, -0.0000005, 1.0000015, 9.3e18, -9.3e18, 1e19, 9.9e21, 2.0**63, 1.5, -2.5e-7]
    values += [float(2**30), 2**30 - 0.0000005, 1073741823.9999995, 0.1 + 0.2, 123456789.1234565, 5e-324, 1e-300]
    values += (rng.normal(size=300) * 10.0 ** rng.integers(-7, 21, 300)).tolist()
    values += (rng.integers(-(10**9), 10**9, 300) / 1e6 + 5e-7).tolist()
    frame = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)] + [("all", v) for v in values], "k string, v double")
    # From 2**53 on doubles are whole numbers, and which of the equal digits a cast shows is up to the JVM.
    cast = {r[0]: r[1] for r in frame.where("k <> 'all'").selectExpr("k", "cast(v as decimal(28,6))").collect()}
    exact = [
        Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP) if abs(v) < 2**53 else cast[f"k{i}"] for i, v in enumerate(values)
    ]
    two = lambda d: d.quantize(Decimal("0.01"), ROUND_HALF_UP)
    plan = roll(frame, group("k"), total("v"))
    assert plan.issues().isEmpty()
    unrounded = {r["g0"]: r["s0"] for r in plan.groups.collect()}
    from decimal import localcontext

    with localcontext() as context:
        context.prec = 60
        expected = {f"k{i}": d for i, d in enumerate(exact)} | {"all": sum(exact, Decimal(0))}
        assert unrounded == expected
        assert {r["k"]: r["v"] for r in plan.release().collect()} == {k: two(d) for k, d in expected.items()}


def test_doubles_beyond_every_sum_are_issues(spark):
    frame = spark.createDataFrame([("a", 1e23), ("b", float("nan")), ("c", float("-inf")), ("d", 1.0)], "k string, v double")
    issues = roll(frame, group("k"), total("v")).issues().collect()
    assert [r["message"] for r in issues] == ["SUM field 'v' is not a number."] * 3


def test_one_aggregate_reads_the_source_once(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    rules = [group("k")] + [
        total("v", output=f"s{i}", condition=lambda f, i=i: f("v") > i) for i in range(5)
    ]
    plan = roll(rows, *rules).groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "Python" not in plan
