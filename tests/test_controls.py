"""Reconciliation and load strategies on literal fixtures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.errors import GateError, PeriodConflict, ReportError
from ledgerspark.operators import load
from ledgerspark.operators.reconcile import compare, confirmation_message
from ledgerspark.sources.target import baseline_rows, period_rows


def both(spark, mine, mine_types, theirs, their_types):
    return spark.createDataFrame(mine, mine_types), spark.createDataFrame(theirs, their_types)


def test_types_and_notations_do_not_matter(spark):
    a, b = both(
        spark,
        [("202605", "1001", 100.0, "8651.93", "（积玉桥店）")],
        "period string, id string, v double, w string, name string",
        [(202605, 1001, 100, 8651.93, " (积玉桥店) ")],
        "period int, id bigint, v int, w double, name string",
    )
    found = compare(a, b, ["period", "id"])
    assert found.differences().isEmpty()
    summary = found.summary().first()
    assert summary["matched"] and summary["next_action"] == "proceed"
    assert summary["diff_type"] == "matched"
    assert confirmation_message(found.summary(), "p", "202605").isEmpty()
    assert compare(a, b, ["period", "name"], ignore=["v"]).differences().isEmpty()


def test_extra_baseline_row(spark):
    a, b = both(
        spark,
        [("202605", "MD00104", 1.0)],
        "period string, shop string, v double",
        [("202605", "MD00104", 1.0), ("202605", "MD00105", 2.0)],
        "period string, shop string, v double",
    )
    found = compare(a, b, ["period", "shop"])
    rows = found.differences().collect()
    assert [(r["shop"], r["issue_type"]) for r in rows] == [("MD00105", "missing_in_preview")]
    assert rows[0]["preview_value"] is None and "2.00" in rows[0]["baseline_value"]
    summary = found.summary().first()
    assert summary["diff_type"] == "missing_in_preview" and summary["difference_count"] == 1
    message = confirmation_message(found.summary(), "p", "202605").first()[0]
    assert "diff_type=missing_in_preview" in message and "difference_count=1" in message


def test_mixed_differences_and_ignored_fields(spark):
    kind = "k string, v string, w string"
    a, b = both(
        spark,
        [("1", "12.345", "x"), ("2", "1", "y"), (None, "5", "z")],
        kind,
        [("1", "12.35", "X"), ("3", "1", "y"), (None, "6", "z")],
        kind,
    )
    found = compare(a, b, ["k"], ignore=["w"])
    rows = {(r["k"], r["issue_type"], r["field"]) for r in found.differences().collect()}
    assert rows == {
        ("2", "missing_in_baseline", "__record__"),
        ("3", "missing_in_preview", "__record__"),
        (None, "value_mismatch", "v"),
    }
    assert found.summary().first()["diff_type"] == "mixed"


def test_fields_of_one_side_only(spark):
    a, b = both(spark, [("1", "a")], "k string, v string", [("1", "z")], "k string, w string")
    rows = compare(a, b, ["k"]).differences().orderBy("field").collect()
    assert [(r["field"], r["preview_value"], r["baseline_value"]) for r in rows] == [
        ("v", "a", None),
        ("w", None, "z"),
    ]


def test_a_table_matches_itself_and_repeats_are_reported(spark):
    rows = spark.createDataFrame(
        [("1", 1.0, 1), ("01", 2.0, 2), ("2", 3.0, 3)], "k string, v double, n int"
    )
    found = compare(rows, rows, ["k"], order="n")
    assert found.summary().first()["matched"]
    repeated = found.duplicate_keys().collect()
    assert [(r["k"], r["preview_n"]) for r in repeated] == [("1", 2)]


TARGET = "record_id string, period string, id string, amount decimal(38,2)"
SOURCE = "period string, id string, amount decimal(38,2)"


def target_of(spark, *rows):
    return spark.createDataFrame([(i, p, k, Decimal(v)) for i, p, k, v in rows], TARGET)


def source_of(spark, *rows):
    return spark.createDataFrame([(p, k, Decimal(v)) for p, k, v in rows], SOURCE)


def actions(spark, source, target, **more):
    found = load.plan_upsert(source, target, ["period", "id"], **more).collect()
    return {r["id"]: (r["action"], r["record_id"]) for r in found}


def test_default_load_stops_at_an_existing_period(spark):
    target = target_of(spark, ("r1", "202605", "163007972", "25455.5"))
    with pytest.raises(PeriodConflict) as caught:
        load.require_empty_period(target, "202605")
    assert caught.value.count == 1
    load.require_empty_period(target, "202606")


def test_upsert_actions(spark):
    target = target_of(
        spark,
        ("r1", "202605", "163007972", "25000.0"),
        ("r2", "202605", "0042", "1.0"),
        ("r3", "202605", "9", "9.0"),
    )
    source = source_of(
        spark, ("202605", "163007972", "25455.5"), ("202605", "42", "1.00"), ("202605", "7", "7")
    )
    assert actions(spark, source, target) == {
        "163007972": ("update", "r1"),
        "42": ("noop", "r2"),
        "7": ("insert", None),
    }


def test_target_only_columns_count_when_strict(spark):
    target = target_of(spark, ("r1", "202605", "1", "1")).withColumn("note", F.lit("kept"))
    source = source_of(spark, ("202605", "1", "1"))
    assert actions(spark, source, target)["1"][0] == "noop"
    assert actions(spark, source, target, strict=True)["1"][0] == "update"


def test_repeated_target_keys_update_the_last_row_only(spark):
    target = target_of(spark, ("r1", "202605", "1", "1"), ("r2", "202605", "01", "1"))
    source = source_of(spark, ("202605", "1", "5"))
    plan = load.plan_upsert(source, target, ["period", "id"])
    state = load.merged_state(plan, target, source.columns).orderBy("record_id").collect()
    assert [(r["record_id"], float(r["amount"])) for r in state] == [("r1", 1.0), ("r2", 5.0)]


def test_stored_upsert_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "target")
    target_of(
        spark,
        ("r1", "202605", "1", "1"),
        ("r2", "202605", "2", "2"),
        ("old", "202604", "1", "1"),
    ).write.partitionBy("period").parquet(path)
    source = source_of(spark, ("202605", "1", "10"), ("202605", "3", "3"))
    states = []
    for expected in ({"update": 1, "insert": 1}, {"noop": 2}):
        counts = load.upsert(spark, source, path, "202605", ["period", "id"])
        assert {r["action"]: r["rows"] for r in counts.collect()} == expected
        rows = spark.read.parquet(path).collect()
        states.append(sorted((str(r["period"]), r["id"], float(r["amount"])) for r in rows))
    assert states[0] == states[1] == [
        ("202604", "1", 1.0),
        ("202605", "1", 10.0),
        ("202605", "2", 2.0),
        ("202605", "3", 3.0),
    ]


def test_a_load_that_breaks_leaves_the_old_state(spark, tmp_path, monkeypatch):
    from ledgerspark.operators.versions import VersionedTable

    table = VersionedTable(spark, str(tmp_path / "target"), target_of(spark).schema.simpleString()[7:-1].replace(":", " "))
    assert table.read().isEmpty()
    first = target_of(spark, ("r1", "202605", "1", "1"), ("r2", "202605", "2", "2"))
    assert table.replace(first, "202605") == 1
    assert table.replace(target_of(spark, ("old", "202604", "1", "1")), "202604") == 1

    def state(**which):
        return sorted((r["period"], r["id"], float(r["amount"])) for r in table.read(**which).collect())

    before = state()
    assert before == [("202604", "1", 1.0), ("202605", "1", 1.0), ("202605", "2", 2.0)]
    source = source_of(spark, ("202605", "1", "10"), ("202605", "3", "3"))

    def broken(self, period, folder):
        raise OSError("no pointer could be written")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "switch", broken)
        with pytest.raises(OSError):
            table.upsert(source, "202605", ["period", "id"])
    assert state() == before
    counts = {r["action"]: r["rows"] for r in table.upsert(source, "202605", ["period", "id"]).collect()}
    assert counts == {"update": 1, "insert": 1}
    after = [("202604", "1", 1.0), ("202605", "1", 10.0), ("202605", "2", 2.0), ("202605", "3", 3.0)]
    assert state() == after
    # Nothing changes, so nothing is written; earlier states stay readable until they are forgotten.
    assert {r["action"] for r in table.upsert(source, "202605", ["period", "id"]).collect()} == {"noop"}
    assert state(period="202605", number=1) == before[1:]
    assert [r["number"] for r in table.current().orderBy("period").collect()] == [1, 2]
    table.forget("202605")
    assert state() == after


def test_upsert_refuses_rows_with_one_key(spark, tmp_path):
    path = str(tmp_path / "target")
    target_of(spark, ("r1", "202605", "1", "1")).write.partitionBy("period").parquet(path)
    source = source_of(spark, ("202605", "（a）", "1"), ("202605", "(a)", "2"))
    with pytest.raises(ReportError):
        load.upsert(spark, source, path, "202605", ["period", "id"])


def test_artifacts(spark, tmp_path):
    empty = source_of(spark).limit(0)
    path = load.write_artifact(empty, str(tmp_path), "pay:settlement", "202605", ["id"])
    assert "/202605_pay_settlement_" in path
    rows, metadata = load.read_artifact(spark, path, "pay:settlement")
    assert rows.columns == ["period", "id", "amount"] and rows.isEmpty()
    assert metadata["group_fields"] == ["id"] and metadata["period"] == "202605"
    with pytest.raises(GateError):
        load.read_artifact(spark, path, "other")


def test_outbound_values(spark):
    rows = spark.createDataFrame([("202605", "12.50"), ("202605", "x")], "period string, v string")
    typed = load.outbound(rows, {"period": 2, "v": 2}).collect()
    assert [float(r["period"]) for r in typed] == [202605.0, 202605.0]
    assert float(typed[0]["v"]) == 12.5 and typed[1]["v"] is None
    problems = load.outbound_problems(rows, {"period": 2, "v": 2}).collect()
    assert [(r["field"], r["value"]) for r in problems] == [("v", "x")]


def test_period_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "stored")
    target_of(spark, ("a", "202604", "1", "1"), ("b", "202605", "1", "2")).write.partitionBy(
        "period"
    ).parquet(path)
    stored = spark.read.parquet(path)
    rows = baseline_rows(stored, "202605", ["amount"])
    assert rows.columns == ["period", "amount"] and rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert "record_id" not in plan
    assert period_rows(stored, 202604).count() == 1
    with pytest.raises(ValueError):
        baseline_rows(stored, "2026-5", [])


def test_join_keys_are_plain_columns(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    found = compare(rows, rows.where("v % 2 = 0"), ["k"])
    plan = found.joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange") == 2


def test_order_that_is_null_or_tied_never_hides_a_mismatch(spark):
    from ledgerspark.operators import reconcile

    schema = "id string, v string, at int"
    for one, two in (([("a", "1", None)], [("a", "2", None)]), ([("a", "1", 5), ("a", "2", 5)], [("a", "1", 5)])):
        left, right = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
        compared = reconcile.compare(left, right, keys=["id"], order="at")
        assert compared.summary().first()["matched"] is False
        assert compared.differences(ordered=True).count() == 1
