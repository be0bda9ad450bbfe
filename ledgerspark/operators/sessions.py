"""Session logs: event kinds, visible text, per-session summaries and the timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.values import strip
from ledgerspark.sources.grid import file_stem
from ledgerspark.sources.jsonl import bare_line, good_lines, line_problem

# Event types and the kinds they are shown as.
TRAJECTORY_KINDS = {
    "prompt": "user",
    "assistant_message": "assistant",
    "final_response": "assistant",
    "tool_call": "tool-call",
    "tool_result": "tool-result",
    "permission_event": "permission",
    "trajectory_gap": "gap",
}
MESSAGE, CALL, CALL_RESULT = "message", "function_call", "function_call_result"
SILENT_TYPES = ["reasoning", "file-history-snapshot"]
UNKNOWN = "unknown"
CONVERSATION = ["user", "assistant"]
TOOL = ["tool-call", "tool-result"]
WARNING = ["permission", "gap"]
MODES = {"conversation": CONVERSATION, "tool": TOOL, "warning": WARNING}

# Content blocks that show text, and the wordings of a refused permission.
OUTPUT_BLOCKS = ["output_text"]
VISIBLE_BLOCKS = ["input_text", "output_text", "text"]
PERMISSION_WORD = "(?i)permission"
REFUSAL_WORD = "(?i)(denied|not available|拒绝)"

# Labels of a log by what it holds.
TRAJECTORY_LOG, SESSION_LOG, PLAIN_LOG = "trajectory", "session", "plain"

EVENT = """
    type string, role string, content string, text string, summary string, name string,
    sessionId string, session_id string, callId string, call_id string, status string,
    arguments string, output string,
    providerData struct<model: string, requestModelName: string, usage: string,
                        argumentsDisplayText: string>,
    message struct<usage: string>
"""


def parse_events(lines: DataFrame) -> DataFrame:
    """Good lines of session logs with their event fields in ``event``."""
    return good_lines(lines).withColumn("event", F.from_json(bare_line(F.col("raw")), EVENT))


def joined_text(content: Column, blocks: Sequence[str]) -> Column:
    """Texts of the named block types of a content list, one per line; '' for anything else."""
    items = F.from_json(content, "array<struct<type: string, text: string>>")
    shown = F.filter(items, lambda b: b["type"].isin(list(blocks)) & (b["text"] != ""))
    text = strip(F.array_join(F.transform(shown, lambda b: b["text"]), "\n"))
    return F.when(content.startswith("["), F.coalesce(text, F.lit(""))).otherwise(F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(column, F.lit("")) for column in columns])


def summarize_sessions(events: DataFrame) -> DataFrame:
    """Per session file: id, last assistant text, model and usage.

    Only aggregates with map-side combine are used, so one long session is no hot spot.
    """
    event = F.col("event")
    is_answer = (event["type"] == MESSAGE) & (event["role"] == "assistant")
    session_id = first_filled(event["sessionId"], event["session_id"])
    provider = event["providerData"]
    answer = F.struct(
        joined_text(event["content"], OUTPUT_BLOCKS).alias("text"),
        first_filled(provider["model"], provider["requestModelName"]).alias("model"),
        F.coalesce(provider["usage"], event["message"]["usage"]).alias("usage"),
    )
    return (
        events.groupBy("session_file")
        .agg(
            F.min_by(session_id, F.when(session_id.isNotNull(), F.col("line_no"))).alias("id"),
            F.max_by(answer, F.when(is_answer, F.col("line_no"))).alias("last"),
            F.count("*").alias("events"),
        )
        .select(
            "session_file",
            F.coalesce("id", file_stem(F.col("session_file"))).alias("session_id"),
            F.coalesce("last.text", F.lit("")).alias("assistant_text"),
            F.col("last.model").alias("model"),
            F.col("last.usage").alias("usage"),
            "events",
        )
    )


def event_kind(event: Column) -> Column:
    """Kind an event is shown as; NULL for silent events and messages without text."""
    kind_of = F.create_map(*[F.lit(x) for pair in TRAJECTORY_KINDS.items() for x in pair])
    trajectory = F.try_element_at(kind_of, event["type"])
    result_text = _result_text(event)
    refused = result_text.rlike(PERMISSION_WORD) & result_text.rlike(REFUSAL_WORD)
    silent = event["type"].isin(SILENT_TYPES)
    empty = (event["type"] == MESSAGE) & (joined_text(event["content"], VISIBLE_BLOCKS) == "")
    return (
        F.when(trajectory.isNotNull(), trajectory)
        .when(silent | empty, F.lit(None).cast("string"))
        .when((event["type"] == MESSAGE) & (event["role"] == "user"), F.lit("user"))
        .when(event["type"] == MESSAGE, F.lit("assistant"))
        .when(event["type"] == CALL, F.lit("tool-call"))
        .when((event["type"] == CALL_RESULT) & refused, F.lit("permission"))
        .when(event["type"] == CALL_RESULT, F.lit("tool-result"))
        .otherwise(F.lit(UNKNOWN))
    )


def event_text(event: Column, raw: Column) -> Column:
    """Text an event is shown with."""
    text = (
        F.when(
            event["type"].isin(list(TRAJECTORY_KINDS)),
            first_filled(event["text"], event["summary"]),
        )
        .when(event["type"] == MESSAGE, joined_text(event["content"], VISIBLE_BLOCKS))
        .when(
            event["type"] == CALL,
            first_filled(
                event["providerData"]["argumentsDisplayText"], event["arguments"], event["name"]
            ),
        )
        .when(event["type"] == CALL_RESULT, _result_text(event))
        .otherwise(raw)
    )
    return F.coalesce(text, F.lit(""))


def normalize_events(events: DataFrame) -> DataFrame:
    """Events as they are shown: one row per event, silent and empty ones left out."""
    event = F.col("event")
    return events.withColumn("kind", event_kind(event)).where("kind is not null").select(
        "session_file",
        "line_no",
        "kind",
        F.coalesce(event["type"], F.lit(UNKNOWN)).alias("event_type"),
        F.coalesce(event["role"], F.lit("")).alias("role"),
        event_text(event, F.col("raw")).alias("text"),
        F.coalesce(event["name"], F.lit("")).alias("tool_name"),
        F.coalesce(first_filled(event["callId"], event["call_id"]), F.lit("")).alias("call_id"),
        F.coalesce(event["status"], F.lit("")).alias("status"),
        "raw",
    )


def _result_text(event: Column) -> Column:
    output = event["output"]
    inner = first_filled(
        F.get_json_object(output, "$.text"), F.get_json_object(output, "$.content")
    )
    return F.when(output.startswith("{"), F.coalesce(inner, output)).otherwise(
        F.coalesce(first_filled(output, event["status"]), F.lit(""))
    )


def kind_counts(lines: DataFrame) -> DataFrame:
    """Counts per session log: objects, shown events per kind, warnings and unreadable lines.

    One pass over the lines and one aggregate answer for both good and unreadable lines.
    """
    filled = lines.where(bare_line(F.col("raw")) != "")
    judged = filled.withColumn("problem", line_problem(F.col("raw"))).withColumn(
        "event", F.from_json(bare_line(F.col("raw")), EVENT)
    )
    kind = F.when(F.col("problem").isNull(), event_kind(F.col("event")))
    shown = judged.select("session_file", "problem", kind.alias("kind"))
    return shown.groupBy("session_file").agg(
        F.count_if(F.col("problem").isNull()).alias("objects"),
        F.count("kind").alias("shown"),
        F.count_if(F.col("kind") == "user").alias("user_events"),
        F.count_if(F.col("kind") == "assistant").alias("assistant_events"),
        F.count_if(F.col("kind") == "tool-call").alias("calls"),
        F.count_if(F.col("kind") == "tool-result").alias("results"),
        F.count_if(F.col("kind").isin(WARNING)).alias("warnings"),
        F.count("problem").alias("errors"),
    )


def timeline(shown: DataFrame, query: str = "", mode: str = "all") -> DataFrame:
    """Events whose JSON holds ``query`` in any case, of the kinds ``mode`` stands for."""
    wanted = query.strip().lower()
    found = shown.where(F.lower("raw").contains(wanted)) if wanted else shown
    return found if mode == "all" else found.where(F.col("kind").isin(MODES[mode]))


def log_kinds(events: DataFrame) -> DataFrame:
    """Per log: whether it holds trajectory events, session events or neither."""
    kind = F.col("event.type")
    trajectory = F.bool_or(F.coalesce(kind.isin(list(TRAJECTORY_KINDS)), F.lit(False)))
    session = F.bool_or(F.coalesce(kind.isin([MESSAGE, CALL, CALL_RESULT]), F.lit(False)))
    label = (
        F.when(trajectory, F.lit(TRAJECTORY_LOG))
        .when(session, F.lit(SESSION_LOG))
        .otherwise(F.lit(PLAIN_LOG))
    )
    return events.groupBy("session_file").agg(label.alias("log_kind"))
