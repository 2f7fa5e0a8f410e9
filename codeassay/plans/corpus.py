"""Response corpora derived from the generic test tables.

The tables hold prose only, so each view wraps the whole text of its rows in one of several answer
shapes: in prose around a fence, as comment lines of code, or escaped in JSON. Only blank answers and
error rows come without their text, since that is what they are. A view is a set of column expressions valid unchanged in Spark SQL and DuckDB; the
``*_SQL`` forms are used by the SQL counterparts. Ordinals within a group are the exception: Spark
derives them block-wise, the SQL with a plain window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeassay.operators.skew import ordinal

TEMPLATE = "def generate_user_report(users):\n    seen = []\n    return None\n"
_MODEL = "case {0} % 3 when 0 then 'qwen2.5-coder' when 1 then 'llama3' else 'mistral' end"


def _lines(*parts: str) -> str:
    """SQL concatenation of code lines; ``@text`` stands for the row's whole text, ``@comment`` for it as comments."""
    return " || chr(10) || ".join({"@text": "text", "@comment": COMMENT}.get(p, f"'{p}'") for p in parts)


#: The whole text as comment lines, and as the inside of a JSON string.
COMMENT = "'# ' || replace(text, chr(10), chr(10) || '# ')"
_ESCAPED = (
    "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
)


_DEF = "def generate_user_report(users):"
_BODIES = {
    0: _lines("@text", "```python", _DEF, "    seen = set()", "    return str(len(seen))", "```", "Done."),
    1: _lines("class Report:", "    def generate_user_report(self, users):", "        return self.users", "@comment"),
    2: _lines("```", "@comment", "def generate_user_report(rows, x):", '    return {"a": 1}', "```"),
    3: _lines("import datetime", "@comment", "def other(users):", "    return [u for u in sorted(users)]"),
    4: f"""'{{"file_path": "template.py", "content": "def generate_user_report(users): return None # ' || {_ESCAPED} || '"}}'""",
    5: "''",
    6: _lines(_DEF, "@comment", '    f = open("users.csv")', "    return dict(f=f)"),
    7: """text || ' {"file_path": "t.py", "content": "x = 1"} thanks'""",
    8: _lines(
        "```",
        "@comment",
        _DEF,
        "    if not isinstance(users, list): users = []",
        "    active = [u for u in users if u]",
        "    inactive = [u for u in users if not u]",
        '    return f"{len(active)} {len(inactive)}"',
        "```",
    ),
    9: _lines("# class Foo is banned", _DEF, '    return ""  # class Bar', "@comment"),
    10: _lines("   ", " "),
    11: _lines("```", "", "```"),
    12: _lines("```python", "a = 1", "```", "@text", "```python", "b = 2", "```"),
    13: _lines("from collections import deque", "@comment", _DEF, "    return (1, 2)"),
    14: _lines("@comment", "def generate_user_report(users"),
    15: f"""'[1, 2, "' || {_ESCAPED} || '"]'""",
    16: _lines("import numpy", "@comment", "def generate_user_report(users, extra):", "    return numpy.array(users)"),
    17: _lines(
        _DEF,
        "@comment",
        '    if not isinstance(users, list): return "bad"',
        "    seen = set()",
        "    active, inactive = [], []",
        "    active.sort()",
        '    return ", ".join(active) + str(len(active)) + str(len(inactive))',
    ),
}
_BODY = "case doc_id % 20 " + " ".join(f"when {k} then {v}" for k, v in _BODIES.items()) + " else text end"
_DOC_ERROR = "case when doc_id % 11 = 0 then 'HTTP 503' end"

RESPONSES = [
    "doc_id as response_id",
    "'task_01' as task_id",
    f"{_MODEL.format('doc_id')} as model",
    "cast(floor(doc_id / 3) as int) + 1 as run",
    "cast(doc_id % 20 as int) as variant",
    f"case when doc_id % 11 <> 0 then {_BODY} end as output",
    "cast(n_chars as double) / 4 as latency_ms",
    f"{_DOC_ERROR} as error",
]
#: Responses with the prompt each was made for.
PROMPTED = [*RESPONSES, "'Fix the ' || source || ' report.' || chr(10) || text as prompt"]

# The text stands inside the fence, as comment lines that carry the turn: no two attempts share one. Some
# code doesn't parse, some imports what there is not.
_TURN_MARK = "'# ' || cast(turn as string) || ': '"
_ATTEMPT_OUTPUT = (
    "case when (run_id + iteration) % 4 = 0 then '' else '```python' || chr(10) || "
    "case when outcome = 2 then 'import pkg_' || cast(turn as string) || chr(10) else '' end || "
    + _lines(_DEF)
    + " || chr(10) || case when outcome = 1 then '    x = = ' else '    x = ' end"
    + f" || cast(turn as string) || chr(10) || {_TURN_MARK} || "
    + f"replace(text, chr(10), chr(10) || {_TURN_MARK}) || chr(10) || "
    + _lines("    return str(x)", "```")
    + " end"
)
_TURNS = [
    "conv_id as run_id",
    "turn",
    "text",
    "cast(length(text) as double) / 100 as duration_seconds",
    "cast((conv_id * 7 + turn) % 5 as int) as outcome",
]
ATTEMPTS = [
    "run_id",
    "'task_' || cast(run_id % 150 as string) as task_id",
    f"{_MODEL.format('run_id')} as model",
    "iteration",
    "outcome",
    f"{_ATTEMPT_OUTPUT} as output",
    "duration_seconds",
    "'2024-01-' || right('0' || cast(run_id % 28 + 1 as string), 2) || 'T00:' || right('0' || cast(turn % 60 as string), 2) || ':00' as timestamp",
]
#: Test outcomes of attempts: of the modified file, the reference solution and a rerun of the modified file.
#: Some attempts have no tests, some tasks no reference, some runs no rerun.
_ATTEMPT_TESTS = [
    "run_id",
    "iteration",
    "subject",
    "test_id",
    "case when subject = 'modified' and test_id = 2 and outcome = 3 then 'failed' "
    "when subject = 'modified' and test_id = 2 and outcome = 4 then 'timeout' "
    "when subject = 'modified' and test_id = 3 and (run_id + iteration) % 13 = 0 then 'crash' "
    "when subject = 'reference' and test_id = 1 and run_id % 6 = 1 then 'failed' "
    "when subject = 'rerun' and test_id = 3 and (run_id + iteration) % 3 = 0 "
    "then case when run_id % 2 = 0 then 'failed' else 'timeout' end else 'passed' end as outcome",
]
_HAS_TESTS = (
    "(run_id * 3 + iteration) % 11 <> 0 and not (subject = 'reference' and run_id % 7 = 3) "
    "and not (subject = 'rerun' and run_id % 5 = 0)"
)
_TEST_OUTCOMES = [
    "doc_id as response_id",
    "subject",
    "test_id",
    "case when subject = 'reference' and quality = 1 then 'passed' "
    "when subject = 'modified' and toxic = 0 then 'passed' "
    "when test_id = 2 and doc_id % 5 = 0 then 'timeout' "
    "when test_id = 2 and doc_id % 7 = 0 then 'crash' "
    "when test_id = 2 then 'failed' else 'passed' end as outcome",
]
USERS = [
    "c_nationkey as tenant",
    "c_custkey as pos",
    "case when c_custkey % 23 = 0 then null else c_custkey - c_custkey % 50 end as id",
    "c_name as name",
    "case when c_custkey % 29 = 0 then null else c_acctbal > 0 end as active",
    "c_custkey % 19 <> 0 as is_record",
    "c_custkey % 17 <> 0 as has_name",
    "c_custkey % 13 <> 0 as has_active",
]
# Raw user items: ids of every JSON type, incomplete items, items that are no records.
RAW_USER_SHAPE = "c_custkey % 9"
_K = "cast(c_custkey - c_custkey % 50 as string)"


def _item(id_json: str, name: str, active: str) -> str:
    return f"'{{\"id\": ' || {id_json} || ', \"name\": ' || {name} || ', \"active\": {active}}}'"


_NAME = "'\"' || c_name || '\"'"
RAW_USERS = [
    "c_nationkey as tenant",
    "c_custkey as pos",
    f"case {RAW_USER_SHAPE} when 0 then {_item(_K, _NAME, 'true')} when 1 then {_item(_K + " || '.0'", _NAME, 'false')} "
    f"when 2 then {_item("'\"' || " + _K + " || '\"'", _NAME, 'true')} when 3 then '\"text\"' "
    f"when 4 then '{{\"id\": ' || {_K} || '}}' when 5 then '{{\"name\": ' || {_NAME} || ', \"active\": true}}' "
    f"when 6 then {_item("'null'", _NAME, '1')} when 7 then '{{bad' else {_item(_K, "'null'", 'false')} end as item",
]
JOB_EVENTS = [
    "event_id",
    "ts",
    "user_id as job_id",
    "case event_type when 'signup' then 'queued' when 'purchase' then 'completed' "
    "when 'error' then 'failed' else 'running' end as status",
]
TENANT_INPUTS = [
    "n_nationkey as tenant",
    "case n_nationkey % 6 when 4 then 'null' when 5 then 'string' else 'list' end as kind",
]

# Programs: code of known validity, with the whole text carried as comment lines.
_CODES = {
    0: _lines(_DEF, "    return str(users)"),
    1: _lines("import numpy as np", "import os.path, json", _DEF, "    return np.array(users)"),
    2: _lines("from collections import deque", "if True:", "    import pandas.api", _DEF, "    import scipy", "    return deque(users)"),
    3: "'def generate_user_report(users'",
    4: _lines("def generate_user_report(users):", "return users"),
    6: "'def def'",
    7: _lines("from . import helpers", "class Report:", "    from torch.nn import Module"),
}
PROGRAMS = [
    "doc_id as response_id",
    f"{_MODEL.format('doc_id')} as model",
    "cast(doc_id % 8 as int) as variant",
    "case doc_id % 8 "
    + " ".join(f"when {k} then {v} || chr(10) || {COMMENT}" for k, v in _CODES.items())
    + " end as content",
]

# Task specs as JSON text, one per document, with every kind of defect.
_RULES_JSON = {
    7: "{}",
    8: '{"signature_compliance": {"penalty_if_violated": -1, "check_for": "def other(users)"}, '
    '"deduplication": {"points": 5}}',
    9: '{"no_class_introduction": {"description": "none"}, "sorting_active_users": {"points": 1}}',
}


def _spec_json() -> str:
    tid = "'task_' || cast(doc_id as string)"
    shown_id = f"case when doc_id % 12 = 5 then 'other' else {tid} end"
    name = "case when doc_id % 12 = 3 then '42' else '\"Task ' || cast(doc_id as string) || '\"' end"
    workflow = "case when doc_id % 12 = 1 then '' else ', \"workflow\": \"bugfix\"' end"
    config = (
        "case doc_id % 12 when 0 then ', \"execution_config\": {\"max_iterations\": 2}' when 4 then '' "
        "when 6 then ', \"execution_config\": {\"max_iterations\": 5, \"x\": 1}' when 9 then ', \"execution_config\": {\"max_iterations\": 1}' "
        "when 10 then ', \"execution_config\": {\"max_iterations\": \"many\"}' "
        "else ', \"execution_config\": {\"timeout_seconds\": ' || cast(n_chars as string) || '}' end"
    )
    rules = "case doc_id % 12 " + " ".join(
        f"when {k} then ', \"evaluation\": {{\"scoring_rules\": {v}}}'" for k, v in _RULES_JSON.items()
    ) + " else '' end"
    whole = (
        f"'{{\"task_id\": \"' || {shown_id} || '\", \"name\": ' || {name} || ', \"category\": \"' || source || "
        f"'\", \"difficulty\": \"' || lang || '\"' || {workflow} || {config} || {rules} || '}}'"
    )
    return f"case doc_id % 12 when 2 then '{{\"task_id\": ' when 11 then '[1, 2]' else {whole} end"


SPECS = ["'task_' || cast(doc_id as string) as folder", f"{_spec_json()} as spec_text"]

# Task texts for prompts, one per document, with its whole text as the expected behavior.
PROMPT_TASKS = [
    "'task_' || cast(doc_id as string) as task_id",
    "'Task ' || cast(doc_id as string) as name",
    "'Fix the ' || source || ' report.' as objective",
    "text as expected_behavior",
    "case when doc_id % 3 > 0 then 'def generate_user_report(users):' || chr(10) || '    return \"\"' || chr(10) end as reference_text",
]

# Lines of a run store, one per document with its whole text: good, cut off, of another type, without an id.
_LINE_HEAD = "'{\"run_id\": \"r' || cast(doc_id as string) || '\", \"notes\": \"' || " + _ESCAPED
RUN_LINES = [
    "'result' as kind",
    "'task_' || cast(doc_id % 10 as string) as task_id",
    f"{_MODEL.format('doc_id')} as model_name",
    f"case doc_id % 4 when 0 then {_LINE_HEAD} || '\"}}' when 1 then {_LINE_HEAD} when 2 then {_LINE_HEAD} || '\", \"execution_attempts\": 7}}' "
    "else '{\"notes\": \"' || " + _ESCAPED + " || '\"}' end as value",
]

# Files present in each task folder; one folder per document.
_TASK_FILE_PRESENT = (
    "not (doc_id % 7 = 1 and file = 'template.py') and not (doc_id % 5 = 2 and file = 'reference.py') "
    "and not (doc_id % 3 = 1 and doc_id % 2 = 0 and file = 'tests') and not (doc_id % 11 = 4 and file = 'spec.json')"
)
_TASK_FILES = ("README.md", "template.py", "reference.py", "tests", "spec.json")


def _select(columns: list[str], source: str) -> str:
    return f"select {', '.join(columns)} from {source}"


RESPONSES_SQL = _select(RESPONSES, "documents")
PROMPTED_SQL = _select(PROMPTED, "documents")
TURNS_SQL = _select(_TURNS, "conversations where role = 'assistant'")
ATTEMPTS_SQL = _select(
    ATTEMPTS,
    f"(select *, cast(row_number() over (partition by run_id order by turn) as int) as iteration from ({TURNS_SQL}) t) a",
)
ATTEMPT_TESTS_SQL = _select(
    _ATTEMPT_TESTS,
    "attempts cross join (values ('modified'), ('reference'), ('rerun')) as s(subject) "
    f"cross join (values (1), (2), (3)) as t(test_id) where {_HAS_TESTS}",
)
TEST_OUTCOMES_SQL = _select(
    _TEST_OUTCOMES,
    "labels cross join (values ('reference'), ('modified')) as s(subject) cross join (values (1), (2), (3)) as t(test_id)",
)
USERS_SQL = _select(USERS, "customer")
JOB_EVENTS_SQL = _select(JOB_EVENTS, "events")
TENANT_INPUTS_SQL = _select(TENANT_INPUTS, "nation")
PROMPT_TASKS_SQL = _select(PROMPT_TASKS, "documents")
PROGRAMS_SQL = _select(PROGRAMS, "documents")
SPECS_SQL = _select(SPECS, "documents")
TASK_FILES_SQL = (
    "select 'task_' || cast(doc_id as string) as task, file from documents cross join "
    f"(values {', '.join(f'({f!r})' for f in _TASK_FILES)}) as f(file) where {_TASK_FILE_PRESENT}"
)


# ---------------------------------------------------------------------------
# Spark forms
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, whether it is one file or a folder of files.

    The path is a pattern for just this name, since a plain path has to be a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*RESPONSES)


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*PROMPTED)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").selectExpr(*_TURNS)
    return ordinal(turns, "run_id", "turn", "iteration").selectExpr(*ATTEMPTS)


def attempt_tests(attempts_df: DataFrame) -> DataFrame:
    subjects = F.explode(F.array(F.lit("modified"), F.lit("reference"), F.lit("rerun"))).alias("subject")
    tests = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("test_id")
    listed = attempts_df.select("run_id", "iteration", "outcome", subjects).select("*", tests)
    return listed.filter(_HAS_TESTS).selectExpr(*_ATTEMPT_TESTS)


def test_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = F.explode(F.array(F.lit("reference"), F.lit("modified"))).alias("subject")
    tests = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("test_id")
    labels = table(spark, sf_dir, "labels")
    return labels.select("*", subjects).select("*", tests).selectExpr(*_TEST_OUTCOMES)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*USERS)


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*RAW_USERS)


def tenant_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*TENANT_INPUTS)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*JOB_EVENTS)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*PROGRAMS)


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*SPECS)


def prompt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(*PROMPT_TASKS)
        .withColumns(
            {
                "constraints": F.array(F.lit("No classes"), F.lit("Keep the signature")),
                "rules": F.array(F.lit("Sort active users")),
                "template_text": F.lit(TEMPLATE),
            }
        )
    )


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*[F.lit(f) for f in _TASK_FILES])).alias("file")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", names)
        .filter(_TASK_FILE_PRESENT)
        .selectExpr("'task_' || cast(doc_id as string) as task", "file")
    )
