"""Session logs, grading and batch statistics on literal fixtures."""

import json

from pyspark.sql import functions as F

from ledgerspark.operators import grading, sessions
from ledgerspark.schemas import SESSION_LINES
from ledgerspark.sources import jsonl


def lines_of(spark, *events, name="logs/one.jsonl"):
    raw = [e if isinstance(e, str) else json.dumps(e, ensure_ascii=False) for e in events]
    return spark.createDataFrame([(name, i + 1, r) for i, r in enumerate(raw)], SESSION_LINES)


USER = {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "roll up"}]}
CALL = {"type": "function_call", "name": "read", "callId": "c1", "arguments": "{}"}
ANSWER = {
    "type": "message",
    "role": "assistant",
    "sessionId": "run-0042",
    "content": [
        {"type": "output_text", "text": "March holds 17 shops,"},
        {"type": "thought", "text": "add them up first"},
        {"type": "output_text", "text": "two of them at zero"},
    ],
    "providerData": {"model": "counter-7", "usage": {"inputTokens": 31, "totalTokens": 58}},
}


def test_session_summary(spark):
    events = sessions.parse_events(lines_of(spark, USER, CALL, ANSWER))
    found = sessions.summarize_sessions(events).first().asDict()
    assert json.loads(found.pop("usage")) == ANSWER["providerData"]["usage"]
    expected = {
        "session_id": "run-0042",
        "assistant_text": "March holds 17 shops,\ntwo of them at zero",
        "model": "counter-7",
        "events": 3,
    }
    assert {name: found[name] for name in expected} == expected


def test_session_without_id_or_answer(spark):
    found = sessions.summarize_sessions(sessions.parse_events(lines_of(spark, USER))).first()
    assert (found["session_id"], found["assistant_text"], found["model"]) == ("one", "", None)


def test_event_kinds(spark):
    events = [
        USER,
        CALL,
        ANSWER,
        {"type": "message", "role": "assistant", "content": []},
        {"type": "reasoning", "text": "hidden"},
        {"type": "file-history-snapshot"},
        {"type": "function_call_result", "name": "read", "output": {"text": "fine"}},
        {"type": "function_call_result", "output": "Permission DENIED for read"},
        {"type": "function_call_result", "output": "permission granted"},
        {"type": "function_call_result", "status": "done"},
        {"type": "trajectory_gap", "summary": "lost"},
        {"type": "prompt", "text": "hello"},
        {"type": "final_response", "text": "bye"},
        {"note": "no type"},
    ]
    shown = sessions.normalize_events(sessions.parse_events(lines_of(spark, *events)))
    found = [(r["line_no"], r["kind"], r["text"]) for r in shown.orderBy("line_no").collect()]
    assert [(n, k) for n, k, _ in found] == [
        (1, "user"),
        (2, "tool-call"),
        (3, "assistant"),
        (7, "tool-result"),
        (8, "permission"),
        (9, "tool-result"),
        (10, "tool-result"),
        (11, "gap"),
        (12, "user"),
        (13, "assistant"),
        (14, "unknown"),
    ]
    texts = {n: t for n, _, t in found}
    assert texts[2] == "{}" and texts[7] == "fine" and texts[10] == "done" and texts[11] == "lost"
    assert shown.where("line_no = 2").first()["call_id"] == "c1"


def test_counts_and_problems(spark):
    lines = lines_of(spark, USER, "", "  ", "{broken", "[1]", '"text"', ANSWER, "﻿" + json.dumps(CALL))
    counts = sessions.kind_counts(lines).first().asDict()
    assert counts == {
        "session_file": "logs/one.jsonl",
        "objects": 3,
        "shown": 3,
        "user_events": 1,
        "assistant_events": 1,
        "calls": 1,
        "results": 0,
        "warnings": 0,
        "errors": 3,
    }
    problems = jsonl.problem_lines(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["problem"]) for r in problems] == [
        (4, jsonl.NOT_JSON),
        (5, jsonl.NOT_AN_OBJECT),
        (6, jsonl.NOT_AN_OBJECT),
    ]


def test_timeline(spark):
    shown = sessions.normalize_events(sessions.parse_events(lines_of(spark, USER, CALL, ANSWER)))
    assert sessions.timeline(shown).count() == 3
    assert [r["line_no"] for r in sessions.timeline(shown, " SHOPS ").collect()] == [3]
    assert [r["line_no"] for r in sessions.timeline(shown, mode="tool").collect()] == [2]


def test_log_kinds(spark):
    logs = (
        lines_of(spark, USER, name="a")
        .unionByName(lines_of(spark, {"type": "prompt"}, USER, name="b"))
        .unionByName(lines_of(spark, {"x": 1}, name="c"))
    )
    found = sessions.log_kinds(sessions.parse_events(logs)).collect()
    assert {r["session_file"]: r["log_kind"] for r in found} == {
        "a": "session",
        "b": "trajectory",
        "c": "plain",
    }


def test_reading_log_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps(USER) + "\n\n" + json.dumps(ANSWER) + "\n")
    lines = jsonl.read_lines(spark, str(tmp_path))
    found = jsonl.good_lines(lines).orderBy("line_no").collect()
    assert [r["line_no"] for r in found] == [1, 3]


def test_verdicts_and_batch(spark):
    rows = [
        ("a", 0, [("g", 1), ("h", 1)], '{"total_tokens":5}'),
        ("b", 0, [("g", 1), ("h", 0)], None),
        ("c", 1, [("g", 1)], '{"totalTokens":7}'),
        ("d", 0, [], None),
    ]
    runs = spark.createDataFrame(
        rows,
        "case_id string, exit_code int, graders array<struct<id:string,score:int>>, usage string",
    )
    judged = grading.with_tokens(grading.verdicts(runs))
    assert {r["case_id"]: (r["status"], r["verdict"]) for r in judged.collect()} == {
        "a": ("completed", "pass"),
        "b": ("completed", "fail"),
        "c": ("failed", "fail"),
        "d": ("completed", "pass"),
    }
    batch = grading.batch_summary(judged).first()
    assert (batch["total"], batch["completed"], batch["passed"], batch["failed"]) == (4, 3, 2, 2)
    assert batch["batch_status"] == "failed"
    assert (batch["tokens_total"], batch["tokens_input"]) == (12, None)
    good = grading.batch_summary(judged.where("case_id = 'a'")).first()
    assert good["batch_status"] == "passed" and good["failed"] == 0


def test_artifact_grader(spark):
    files = spark.createDataFrame(
        [
            ("a", "outputs/x.txt", 9, b"t"),
            ("a", "outputs/new.json", 8, b"n"),
            ("a", "outputs/Preview-old.XLSX", 1, b"p"),
            ("b", "outputs/one.csv", 1, b"1"),
            ("b", "outputs/two.csv", 2, b"22"),
            ("c", "outputs/notes.md", 2, b"m"),
        ],
        "case_id string, path string, modificationTime int, content binary",
    ).withColumn("length", F.octet_length("content"))
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    found = {r["case_id"]: r for r in grading.grade_artifacts(cases, files).collect()}
    assert found["a"]["file"] == "outputs/Preview-old.XLSX" and found["a"]["score"] == 1
    assert found["b"]["file"] == "outputs/two.csv" and found["b"]["size_bytes"] == 2
    assert len(found["b"]["sha256"]) == 64
    assert found["c"]["score"] == 0 and found["c"]["sha256"] is None


def test_newest_changed(spark):
    kind = "owner string, path string, modificationTime int"
    before = spark.createDataFrame([("u", "a", 5), ("u", "b", 1)], kind)
    after = spark.createDataFrame([("u", "a", 5), ("u", "b", 2), ("u", "c", 1)], kind)
    assert grading.newest_changed(before, after, "owner").first()["path"] == "b"
    assert grading.newest_changed(after, after, "owner").isEmpty()


def test_evidence_and_selection(spark):
    results = spark.createDataFrame([("a", None), ("b", "x")], "case_id string, session string")
    marked = grading.missing_evidence(results, {"session_jsonl": F.col("session").isNull()})
    assert {r["case_id"]: r["missing"] for r in marked.collect()} == {
        "a": ["session_jsonl"],
        "b": [],
    }
    wanted = grading.request(spark.sql("select array('b', 'z', 'a') as ids"), "ids")
    chosen = grading.selected_cases(results, wanted).orderBy("request_no").collect()
    assert [r["case_id"] for r in chosen] == ["b", "a"]
    assert [r["case_id"] for r in grading.missing_cases(results, wanted).collect()] == ["z"]
    declared = spark.createDataFrame([("g",), ("h",)], "grader string")
    unknown = grading.unknown_graders(declared, declared.where("grader = 'g'")).collect()
    assert [r["grader"] for r in unknown] == ["h"]


def test_lines_with_a_repeated_key_are_good(spark):
    from ledgerspark.sources.jsonl import good_lines

    lines = spark.createDataFrame([('{"type":"a","type":"message"}',), ('{"type":',)], "raw string")
    assert [row["raw"] for row in good_lines(lines).collect()] == ['{"type":"a","type":"message"}']
