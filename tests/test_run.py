"""Validation reports and whole runs on a small setup."""

import pytest

from ledgerspark.errors import GateError, PeriodConflict, RollupIssues, RuleError, ValidationFailed
from ledgerspark.plans import run
from ledgerspark.plans.rules import PatchBook
from ledgerspark.plans.validate import source_checks
from ledgerspark.schemas import GRID, PROJECTS, RULES, SHEET_SPECS, TARGET_FIELDS

GOOD_RULES = [
    ("p", "shop", "GROUP", "S", None, "shop", None, False),
    ("p", "amount", "SUM", "S", None, "amount", "`kind` <=> 'sale'", False),
]
GOOD_FIELDS = [("t", "period", 1), ("t", "shop", 3), ("t", "amount", 2)]
ROWS = [["shop", "kind", "amount"], ["A", "sale", "10"], ["A", "other", "5"], ["B", "sale", "1"]]


def setup(spark, rules=GOOD_RULES, fields=GOOD_FIELDS, specs=None):
    listed = spark.createDataFrame(rules, RULES)
    return run.Setup(
        projects=spark.createDataFrame([("p", "Project", "t"), ("q", "Lost", "gone")], PROJECTS),
        specs=spark.createDataFrame(specs or [("p", "S", None, 1, -1, False)], SHEET_SPECS),
        rules=listed,
        target_fields=spark.createDataFrame(fields, TARGET_FIELDS),
        patches=PatchBook(),
    )


def grid(spark, rows=ROWS, source="one.xlsx"):
    return spark.createDataFrame([(source, "S", i + 1, r) for i, r in enumerate(rows)], GRID)


def failed(report):
    return sorted((r["check_name"], r["scope"]) for r in report.where("not passed").collect())


def test_valid_setup(spark):
    report = run.validate(setup(spark), "p", grid(spark))
    names = sorted(r["check_name"] for r in report.collect())
    assert names == sorted(
        ["sheet_exists", "data_range", "field_exists", "field_exists", "condition_valid"]
        + ["target_field_exists", "target_field_type"] * 3
    )


@pytest.mark.parametrize(
    "condition, code",
    [
        ("CONDITION", "condition_placeholder_detected"),
        ("`nothing` = 'x'", "condition_identifier_unresolved"),
        ("`kind` = = 'x'", "condition_parse_failed"),
        ("strange(`kind`)", "condition_function_not_allowed"),
    ],
)
def test_condition_report(spark, condition, code):
    rules = [GOOD_RULES[0], (*GOOD_RULES[1][:6], condition, False)]
    with pytest.raises(ValidationFailed) as caught:
        run.validate(setup(spark, rules), "p", grid(spark))
    bad = caught.value.report.where("not passed").collect()
    assert [(r["check_name"], r["details"]["code"]) for r in bad] == [("condition_valid", code)]


def test_every_file_is_checked(spark):
    other = grid(spark, [["shop", "kind"], ["A", "sale"]], "two.xlsx")
    report = source_checks(grid(spark).unionByName(other), setup(spark).bundle("p"))
    bad = report.where("not passed").collect()
    assert [(r["check_name"], r["details"]["source_file"]) for r in bad] == [
        ("field_exists", "two.xlsx")
    ]


def test_missing_sheets(spark):
    specs = [("p", "S", None, 1, -1, False), ("p", "T", None, 1, -1, False)]
    report = source_checks(grid(spark), setup(spark, specs=specs).bundle("p"))
    assert failed(report) == [("data_range", "sheet:T"), ("sheet_exists", "sheet:T")]
    specs[1] = ("p", "T", None, 1, -1, True)
    assert failed(source_checks(grid(spark), setup(spark, specs=specs).bundle("p"))) == []


def test_target_checks(spark):
    fields = [("t", "period", 3), ("t", "amount", 1)]
    with pytest.raises(ValidationFailed) as caught:
        run.validate(setup(spark, fields=fields), "p", grid(spark))
    assert failed(caught.value.report) == [
        ("target_field_exists", "target_field:shop"),
        ("target_field_type", "target_field:amount"),
        ("target_field_type", "target_field:period"),
    ]


def test_gates(spark):
    for project in ("nobody", "q"):
        with pytest.raises(GateError):
            run.validate(setup(spark), project, grid(spark))
    doubled = [*GOOD_RULES, GOOD_RULES[1]]
    with pytest.raises(RuleError):
        run.validate(setup(spark, doubled), "p", grid(spark))


def test_preview_reports_located_issues(spark):
    rows = [*ROWS, ["C", "sale", "1x"]]
    with pytest.raises(RollupIssues) as caught:
        run.preview(setup(spark), "p", grid(spark, rows), "202605")
    issue = caught.value.report.first()
    assert (issue["source_file"], issue["sheet"], issue["row_no"], issue["field"]) == (
        "one.xlsx",
        "S",
        5,
        "amount",
    )


def test_full_run(spark, tmp_path):
    target = str(tmp_path / "target")
    spark.createDataFrame(
        [("r0", "202604", "A", 1)], "record_id string, period string, shop string, amount int"
    ).selectExpr("record_id", "period", "shop", "cast(amount as decimal(38,2)) amount").write.partitionBy(
        "period"
    ).parquet(target)
    folder = str(tmp_path / "artifacts")
    job = setup(spark)
    first = run.run_full(job, "p", grid(spark), "202605", folder, target).first()
    assert (first["row_count"], first["field_count"]) == (2, 3)

    def state():
        rows = spark.read.parquet(target).where("period = '202605'").collect()
        return sorted((r["shop"], float(r["amount"])) for r in rows)

    assert state() == [("A", 10.0), ("B", 1.0)]
    result = run.preview(job, "p", grid(spark, [*ROWS, ["B", "sale", "4"]]), "202605")
    from ledgerspark.operators.load import write_artifact

    artifact = write_artifact(result, str(tmp_path / "second"), "p", "202605", ["shop"])
    with pytest.raises(PeriodConflict):
        run.upload(job, "p", artifact, target)
    run.upload(job, "p", artifact, target, run.UPSERT)
    assert state() == [("A", 10.0), ("B", 5.0)]
    run.upload(job, "p", artifact, target, run.APPEND)
    assert len(state()) == 4
