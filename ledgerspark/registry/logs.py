"""Session logs, grading and batch statistics over conversations, events and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import grading, sessions
from ledgerspark.registry.base import query, table
from ledgerspark.session import scratch_path
from ledgerspark.sources import files, jsonl
from ledgerspark.sources.jsonl import line_problem, problem_lines

# Every conversation is a session log: turns are its lines. Some turns are tool calls, results,
# trajectory events, silent events or broken lines.
_KIND = "(conv_id * 7 + turn) % 12"
_LINES_SQL = f"""
    lines AS (
        SELECT 'logs/session-' || conv_id || '.jsonl' AS session_file, turn + 1 AS line_no, conv_id, turn,
               {_KIND} AS k, role, text FROM conversations),
    events AS (
        SELECT *, CASE
            WHEN k = 6 THEN 'tool-call'
            WHEN k = 7 THEN CASE WHEN regexp_matches(text, '(?i)permission')
                                  AND regexp_matches(text, '(?i)(denied|not available|拒绝)') THEN 'permission'
                                 ELSE 'tool-result' END
            WHEN k = 8 THEN 'permission' WHEN k = 9 THEN 'gap' WHEN k IN (10, 11) THEN NULL
            WHEN k = 5 THEN NULL WHEN k = 4 THEN 'unknown'
            WHEN k = 3 THEN NULL
            WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS kind FROM lines)
"""


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines as a log writer would leave them."""
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 12
    block = F.when(F.col("role") == "user", F.lit("input_text")).otherwise(F.lit("output_text"))
    shown = F.array(
        F.struct(block.alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("hidden").alias("text")),
        F.struct(block.alias("type"), F.lit("end").alias("text")),
    )
    none = F.array().cast("array<struct<type:string,text:string>>")
    session_id = F.when(
        (F.col("turn") > 0) & (F.col("conv_id") % 4 != 0),
        F.concat(F.lit("s-"), F.col("conv_id").cast("string")),
    )
    provider = F.struct(
        F.when(F.col("turn") % 2 == 1, F.lit("model-a")).alias("model"),
        F.lit("model-b").alias("requestModelName"),
        F.struct((F.col("turn") * 10).alias("inputTokens")).alias("usage"),
    )

    def message(content: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("message").alias("type"),
                "role",
                content.alias("content"),
                session_id.alias("sessionId"),
                provider.alias("providerData"),
            )
        )

    def other(kind_name: str, **more: Column) -> Column:
        fields = [value.alias(name) for name, value in more.items()]
        return F.to_json(F.struct(F.lit(kind_name).alias("type"), *fields))

    text = F.col("text")
    raw = (
        F.when(kind == 3, message(none))
        .when(kind == 4, other("odd", note=text))
        .when(kind == 5, other("reasoning", text=text))
        .when(kind == 6, other("function_call", name=F.lit("tool"), arguments=text))
        .when(
            kind == 7,
            other("function_call_result", name=F.lit("tool"), output=F.struct(text.alias("text"))),
        )
        .when(kind == 8, other("permission_event", summary=text))
        .when(kind == 9, other("trajectory_gap", summary=text))
        .when(kind == 10, F.concat(F.lit('{"type": "message", '), text))
        .when(kind == 11, F.lit("[1, 2]"))
        .otherwise(message(shown))
    )
    return table(spark, sf_dir, "conversations").select(
        F.format_string("logs/session-%d.jsonl", "conv_id").alias("session_file"),
        (F.col("turn") + 1).alias("line_no"),
        raw.alias("raw"),
    )


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, line_no, k NOT IN (10, 11) AS good,
           CASE k WHEN 10 THEN 'not valid JSON' WHEN 11 THEN 'not a JSON object' END AS problem FROM lines"""
)
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a log are events and why the others are not."""
    problem = line_problem(F.col("raw"))
    return session_lines(spark, sf_dir).select(
        "session_file", "line_no", problem.isNull().alias("good"), problem.alias("problem")
    )


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, count(*) AS problems, min(line_no) AS first_line
    FROM lines WHERE k IN (10, 11) GROUP BY 1"""
)
def jsonl_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable lines per log."""
    return problem_lines(session_lines(spark, sf_dir)).groupBy("session_file").agg(
        F.count("*").alias("problems"), F.min("line_no").alias("first_line")
    )


_WS = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    f"""WITH {_LINES_SQL},
    seen AS (SELECT *, k < 3 AS shown FROM lines WHERE k NOT IN (10, 11)),
    last AS (
        SELECT session_file, arg_max(CASE WHEN shown THEN trim(text || chr(10) || 'end', {_WS}) ELSE '' END, line_no) AS answer,
               arg_max(CASE WHEN turn % 2 = 1 THEN 'model-a' ELSE 'model-b' END, line_no) AS model,
               arg_max('{{"inputTokens":' || turn * 10 || '}}', line_no) AS usage
        FROM seen WHERE role <> 'user' AND role = 'assistant' AND k <= 3 GROUP BY 1),
    ids AS (SELECT session_file, max('s-' || conv_id) AS id FROM seen
            WHERE k <= 3 AND turn > 0 AND conv_id % 4 <> 0 GROUP BY 1),
    files AS (SELECT session_file, max(conv_id) AS conv_id, count(*) AS events FROM seen GROUP BY 1)
    SELECT session_file, coalesce(id, 'session-' || conv_id) AS session_id, coalesce(answer, '') AS assistant_text,
           model, usage, events
    FROM files LEFT JOIN last USING (session_file) LEFT JOIN ids USING (session_file)"""
)
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, last assistant text, model and usage of every session."""
    events = sessions.parse_events(session_lines(spark, sf_dir))
    return sessions.summarize_sessions(events)


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, line_no,
           CASE WHEN k >= 3 OR role = 'user' THEN '' ELSE trim(text || chr(10) || 'end', {_WS}) END AS output_text,
           CASE WHEN k >= 3 THEN '' ELSE trim(text || chr(10) || 'end', {_WS}) END AS visible_text
    FROM lines WHERE k NOT IN (10, 11)"""
)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of messages joined line by line; other blocks stay hidden."""
    events = sessions.parse_events(session_lines(spark, sf_dir))
    content = F.coalesce(F.col("event.content"), F.lit(""))
    return events.select(
        "session_file",
        "line_no",
        sessions.joined_text(content, sessions.OUTPUT_BLOCKS).alias("output_text"),
        sessions.joined_text(content, sessions.VISIBLE_BLOCKS).alias("visible_text"),
    )


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, line_no, kind,
           CASE WHEN k < 3 THEN trim(text || chr(10) || 'end', {_WS}) WHEN kind = 'unknown' THEN '' ELSE text END AS text
    FROM events WHERE kind IS NOT NULL"""
)
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are shown: user, assistant, tool call, tool result, permission, gap, unknown."""
    shown = sessions.normalize_events(sessions.parse_events(session_lines(spark, sf_dir)))
    text = F.when(F.col("kind") == "unknown", F.lit("")).otherwise(F.col("text"))
    return shown.select("session_file", "line_no", "kind", text.alias("text"))


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, count(*) FILTER (WHERE k NOT IN (10, 11)) AS objects, count(kind) AS shown,
           count(*) FILTER (WHERE kind = 'user') AS user_events,
           count(*) FILTER (WHERE kind = 'assistant') AS assistant_events,
           count(*) FILTER (WHERE kind = 'tool-call') AS calls,
           count(*) FILTER (WHERE kind = 'tool-result') AS results,
           count(*) FILTER (WHERE kind IN ('permission', 'gap')) AS warnings,
           count(*) FILTER (WHERE k IN (10, 11)) AS errors
    FROM events GROUP BY 1"""
)
def event_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per kind of event, warnings and unreadable lines of every log."""
    return sessions.kind_counts(session_lines(spark, sf_dir))


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, line_no, kind FROM events
    WHERE kind IN ('tool-call', 'tool-result') AND contains(lower(text), 'que')"""
)
def timeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool events whose content holds a text, in any case."""
    shown = sessions.normalize_events(sessions.parse_events(session_lines(spark, sf_dir)))
    found = sessions.timeline(shown, query=" QUE ", mode="tool")
    return found.select("session_file", "line_no", "kind")


@query(
    f"""WITH {_LINES_SQL}
    SELECT session_file, CASE WHEN bool_or(k IN (8, 9)) THEN 'trajectory'
                              WHEN bool_or(k < 4 OR k IN (6, 7)) THEN 'session' ELSE 'plain' END AS log_kind
    FROM lines WHERE k NOT IN (10, 11) GROUP BY 1"""
)
def log_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every log holds: trajectory events, session events or neither."""
    return sessions.log_kinds(sessions.parse_events(session_lines(spark, sf_dir)))


@query(
    """
    SELECT 'logs 1+2 单据' AS folder, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS line_no, conv_id, turn
    FROM conversations"""
)
def log_lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of written log files: numbers as they stand in the file, names as they are on disk."""
    path = scratch_path(spark, "session-logs")
    line = F.to_json(F.struct("conv_id", "turn"))
    turns = table(spark, sf_dir, "conversations").repartition(8, "role").sortWithinPartitions("role", "conv_id", "turn")
    turns.select("role", line.alias("line")).write.partitionBy("role").text(f"{path}/logs 1+2 单据")
    found = jsonl.read_lines(spark, path)
    place = F.col("session_file")
    return found.select(
        F.regexp_extract(place, "/(logs[^/]*)/", 1).alias("folder"), F.regexp_extract(place, "/role=([^/]*)/", 1).alias("role"),
        "line_no", F.get_json_object("raw", "$.conv_id").cast("bigint").alias("conv_id"),
        F.get_json_object("raw", "$.turn").cast("bigint").alias("turn"),
    )


@query(
    """
    WITH sources AS (
        SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
    texts AS (
        SELECT source, lang, string_agg(doc_id, chr(10) ORDER BY doc_id) || chr(10) AS text
        FROM documents WHERE source IS NOT NULL GROUP BY source, lang),
    best AS (SELECT source, max(lang) AS lang FROM texts GROUP BY source)
    SELECT source AS case_id, 1 AS score, 'lang=' || lang AS folder, strlen(text) AS size_bytes, sha256(text) AS sha256
    FROM best JOIN texts USING (source, lang)"""
)
def graded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of written files: the last of each case is opened, no other."""
    path = scratch_path(spark, "outputs")
    docs = table(spark, sf_dir, "documents").where("source is not null")
    ordered = docs.repartition(8, "source", "lang").sortWithinPartitions("source", "lang", "doc_id")
    ordered.select("source", "lang", F.col("doc_id").cast("string")).write.partitionBy("source", "lang").csv(path)
    listed = files.file_inventory(spark, path).select(
        F.regexp_extract("path", "/source=([^/]*)/", 1).alias("case_id"), "path", "length",
        # Files of one job are written at no telling times; ties go to the last path.
        F.lit(0).alias("modificationTime"),
    )
    graded = grading.grade_files(docs.select(F.col("source").alias("case_id")).distinct(), listed)
    return graded.select(
        "case_id", "score", F.regexp_extract("file", "/(lang=[^/]*)/", 1).alias("folder"), "size_bytes", "sha256"
    )


@query(
    """
    SELECT doc_id, regexp_matches(text, '(?i)permission')
                   AND regexp_matches(text, '(?i)(denied|not available|拒绝)') AS refused,
           regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)(and|of|que)') AS both_words
    FROM documents"""
)
def refusal_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused permissions by wording, over whole texts."""
    text = F.col("text")
    refused = text.rlike(sessions.PERMISSION_WORD) & text.rlike(sessions.REFUSAL_WORD)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        refused.alias("refused"),
        (text.rlike("(?i)the") & text.rlike("(?i)(and|of|que)")).alias("both_words"),
    )


# Grading. Documents are output files of cases (their source); pages are files, too.

_FILES_SQL = """
    files AS (
        SELECT source AS case_id, 'outputs/' || lang || '/doc-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt'
                   WHEN 1 THEN '.JSON' WHEN 2 THEN '-Preview.csv' ELSE '.csv' END AS path,
               n_chars % 1000 AS mtime, doc_id % 4 AS kind, strlen(text) AS size, text
        FROM documents)
"""


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    suffix = (
        F.when(kind == 0, F.lit(".txt"))
        .when(kind == 1, F.lit(".JSON"))
        .when(kind == 2, F.lit("-Preview.csv"))
        .otherwise(F.lit(".csv"))
    )
    name = F.concat(F.lit("outputs/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("case_id"),
        name.alias("path"),
        (F.col("n_chars") % 1000).alias("modificationTime"),
        F.octet_length("text").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query(
    f"""WITH {_FILES_SQL},
    cases AS (SELECT DISTINCT source AS case_id FROM documents
              UNION ALL SELECT DISTINCT p_brand FROM part),
    best AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY kind = 2 DESC, mtime DESC, path DESC) AS n
        FROM files WHERE kind <> 0) WHERE n = 1)
    SELECT case_id, 'preview_file_exists' AS grader, CASE WHEN path IS NULL THEN 0 ELSE 1 END AS score,
           path AS file, size AS size_bytes, sha256(text) AS sha256
    FROM cases LEFT JOIN best USING (case_id)"""
)
def artifact_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per case for its artifact, with size and SHA-256 of the whole file."""
    cases = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")).distinct()
    others = table(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id")).distinct()
    return grading.grade_artifacts(cases.unionByName(others), output_files(spark, sf_dir))


@query(
    f"""WITH {_FILES_SQL}
    SELECT case_id, path FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY kind = 2 DESC, mtime DESC, path DESC) AS n
        FROM files WHERE kind <> 0) WHERE n = 1"""
)
def newest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest artifact per case, preview-named files first."""
    return grading.pick_artifacts(output_files(spark, sf_dir).drop("content", "length"))


@query(
    """
    SELECT user_id, 'log-' || event_id AS path FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'log-' || event_id DESC) AS n
        FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0) WHERE n = 1"""
)
def newest_changed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest log per user that is new or has grown since the earlier listing."""
    path = F.concat(F.lit("log-"), F.col("event_id").cast("string"))
    events = table(spark, sf_dir, "events")
    after = events.select("user_id", path.alias("path"), F.col("ts").alias("modificationTime"))
    older = F.col("ts") - F.expr("interval 1 hour")
    time = F.when(F.col("event_id") % 2 == 0, older).otherwise(F.col("ts"))
    before = events.where(F.col("event_id") % 3 == 0).select(
        path.alias("path"), time.alias("modificationTime")
    )
    return grading.newest_changed(before, after, "user_id")


# Cases are labelled documents: two graders, an exit code and a usage object each.
_CASES_SQL = """
    cases AS (
        SELECT doc_id, quality, toxic, source, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS exit_code,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS tokens
        FROM labels JOIN documents USING (doc_id)),
    judged AS (
        SELECT *, exit_code = 0 AND (doc_id % 7 = 0 OR (quality = 1 AND toxic = 0)) AS good FROM cases)
"""


def case_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")

    def grade(name: str, score: Column) -> Column:
        return F.struct(F.lit(name).alias("id"), score.cast("int").alias("score"))

    graders = F.array(
        grade("quality", F.col("quality")), grade("clean", F.lit(1) - F.col("toxic"))
    )
    none = F.array().cast("array<struct<id:string,score:int>>")
    usage = F.when(
        key % 5 != 0, F.concat(F.lit('{"total_tokens":'), F.col("n_chars"), F.lit("}"))
    )
    return labels.join(documents.select("doc_id", "source", "n_chars"), "doc_id").select(
        "doc_id",
        "source",
        F.when(key % 11 == 0, 1).otherwise(0).alias("exit_code"),
        F.when(key % 7 == 0, none).otherwise(graders).alias("graders"),
        usage.alias("usage"),
    )


@query(
    f"""WITH {_CASES_SQL}
    SELECT doc_id, CASE WHEN exit_code = 0 THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN good THEN 1 ELSE 0 END AS score, CASE WHEN good THEN 'pass' ELSE 'fail' END AS verdict
    FROM judged"""
)
def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, score and verdict of every case; a case without graders passes if it completed."""
    runs = grading.verdicts(case_runs(spark, sf_dir))
    return runs.select("doc_id", "status", "score", "verdict")


_BATCH_SQL = """
           count(*) AS total, count(*) FILTER (WHERE exit_code = 0) AS completed,
           count(*) FILTER (WHERE good) AS passed, count(*) FILTER (WHERE NOT good) AS failed,
           CAST(NULL AS BIGINT) AS tokens_input, CAST(NULL AS BIGINT) AS tokens_output,
           CAST(sum(tokens) AS BIGINT) AS tokens_total,
           CASE WHEN count(*) FILTER (WHERE NOT good) = 0 THEN 'passed' ELSE 'failed' END AS batch_status
    FROM judged
"""


@query(f"WITH {_CASES_SQL} SELECT {_BATCH_SQL}")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, status and token totals of one batch; a total without values is NULL."""
    runs = grading.with_tokens(grading.verdicts(case_runs(spark, sf_dir)))
    return grading.batch_summary(runs)


@query(f"WITH {_CASES_SQL} SELECT source, {_BATCH_SQL} GROUP BY source")
def batch_totals_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per suite."""
    runs = grading.with_tokens(grading.verdicts(case_runs(spark, sf_dir)))
    return grading.batch_summary(runs, by=["source"])


@query(
    """
    SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'runner_result' END,
               CASE WHEN NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'session_jsonl' END,
               CASE WHEN n_chars < 200 THEN 'outputs' END) AS missing
    FROM documents d"""
)
def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the evidence every case lacks."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    results = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    gaps = grading.missing_evidence(
        results,
        {
            "runner_result": F.col("doc_id") % 3 == 0,
            "session_jsonl": F.col("labelled").isNull(),
            "outputs": F.col("n_chars") < 200,
        },
    )
    return gaps.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query(
    """
    SELECT p_partkey, p_type AS grader FROM part
    WHERE p_type NOT IN (SELECT p_type FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0)"""
)
def unknown_graders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared graders nobody has registered."""
    part = table(spark, sf_dir, "part")
    declared = part.select("p_partkey", F.col("p_type").alias("grader"))
    firsts = part.groupBy(F.col("p_type").alias("grader")).agg(F.min("p_partkey").alias("first"))
    known = firsts.where(F.col("first") % 2 == 0)
    return grading.unknown_graders(declared, known).select("p_partkey", "grader")


_REQUESTS_SQL = """
    asked AS (
        SELECT o_orderkey AS request, CAST(i - 1 AS INT) AS request_no, ids[i] AS case_id FROM (
            SELECT o_orderkey, [o_custkey * 2, o_custkey, o_orderkey] AS ids FROM orders), range(1, 4) t(i))
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ids = F.array(F.col("o_custkey") * 2, F.col("o_custkey"), F.col("o_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("request"), F.posexplode(ids).alias("request_no", "case_id")
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_name").alias("name")
    )


@query(
    f"""WITH {_REQUESTS_SQL}
    SELECT request, request_no, case_id, c_name AS name FROM asked JOIN customer ON c_custkey = case_id"""
)
def selected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested cases with the place they were asked for at."""
    return grading.selected_cases(_cases(spark, sf_dir), _requests(spark, sf_dir))


@query(
    f"""WITH {_REQUESTS_SQL}
    SELECT request, request_no, case_id FROM asked WHERE case_id NOT IN (SELECT c_custkey FROM customer)"""
)
def missing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested cases that do not exist."""
    return grading.missing_cases(_cases(spark, sf_dir), _requests(spark, sf_dir))
