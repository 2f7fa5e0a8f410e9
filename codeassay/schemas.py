"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the documented evaluation rules exactly.
# ---------------------------------------------------------------------------

REGISTERED_MODELS = ("qwen2.5-coder", "llama3", "mistral")

REQUIRED_TASK_FILES = ("template.py", "reference.py", "tests", "spec.json")

REQUIRED_SPEC_FIELDS = ("task_id", "name", "category", "difficulty", "workflow")

SPEC_DEFAULTS = {
    "language": "python",
    "entry_file": "template.py",
    "expected_behavior": "",
    "max_iterations": 3,
    "timeout_seconds": 60,
    "test_command": "pytest tests/ -v",
    "method": "rule_based_compliance",
    "max_score": 10,
    "compliance_threshold": "",
}
DEFAULT_VALIDATION_ORDER = ("syntax", "imports", "tests")

SIGNATURE = "def generate_user_report(users)"
ENTRY_FUNCTION = "generate_user_report"
DEFAULT_FILE_PATH = "template.py"
EMPTY_OUTPUT_ERROR = "Empty output from model"
NO_OUTPUT_ISSUE = "No output generated"

# rule -> (kind, default weight, default check_for text)
DEFAULT_RULES = {
    "signature_compliance": ("penalty", -3, SIGNATURE),
    "no_class_introduction": ("penalty", -2, "absence of 'class' keyword"),
    "no_self_parameter": ("penalty", -3, "absence of 'def generate_user_report(self'"),
    "deduplication": ("bonus", 2, "set() or 'seen' variable"),
    "sorting_active_users": ("bonus", 2, "sort() or sorted() call"),
    "correct_counts": ("bonus", 2, "active/inactive user counts"),
    "robust_input_handling": ("bonus", 1, "isinstance() or type checks"),
    "string_return_format": ("bonus", 1, "return statement with string concatenation or .join()"),
}

# category -> its failure modes; the modes appear in reporting order
FAILURE_CATEGORIES = {
    "Signature Issues": (
        "signature_parameter_mismatch",
        "completely_different_name",
        "no_function_definition",
    ),
    "OOP Drift": ("class_introduction", "self_parameter_oop"),
    "Hallucinations": (
        "file_io_hallucination",
        "external_dependency_datetime",
        "suspicious_external_imports",
    ),
    "Type Mismatches": ("returns_dict_not_string", "returns_non_string_iterable"),
    "Missing Logic": ("no_deduplication", "no_sorting", "no_active_inactive_separation"),
}
NO_FAILURE = "no_failures_detected"

ERROR_TYPES = (
    "syntax_error",
    "import_error",
    "verification_failed",
    "timeout",
    "runtime_crash",
    "patch_application_failed",
)
REPORT_STAGES = ("syntax", "imports", "tests")
JOB_STATUSES = ("queued", "running", "completed", "failed")

# Every character Python's str.strip() and regex \s treat as whitespace; all lie below U+3001.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

FAILURE_MODES = tuple(mode for modes in FAILURE_CATEGORIES.values() for mode in modes)

RULE_STRUCT = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("penalty_if_violated", T.IntegerType()),
        T.StructField("points", T.IntegerType()),
        T.StructField("check_for", T.StringType()),
    ]
)
SCORING_RULES = T.MapType(T.StringType(), RULE_STRUCT)

RESPONSES = T.StructType(
    [
        T.StructField("response_id", T.LongType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("output", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

STAGE = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
    ]
)
ATTEMPT = T.StructType(
    [
        T.StructField("iteration", T.IntegerType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("stages", T.ArrayType(STAGE)),
    ]
)
RUN_RESULT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("execution_attempts", T.ArrayType(ATTEMPT)),
    ]
)

def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_TEXT, _INT, _FLOAT, _FLAG = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STAGE_RESULT = _fields(
    ("stage", _TEXT), ("passed", _FLAG), ("error_type", _TEXT), ("error_message", _TEXT), ("details", T.MapType(_TEXT, _TEXT))
)
VALIDATION_REPORT = _fields(
    ("overall_passed", _FLAG),
    ("stages", T.ArrayType(STAGE_RESULT)),
    ("regression_detected", _FLAG),
    ("regression_details", _TEXT),
    ("original_template_hash", _TEXT),
    ("modified_template_hash", _TEXT),
)
EXECUTION_ATTEMPT = _fields(
    ("iteration", _INT),
    ("timestamp", _TEXT),
    ("model_output_raw", _TEXT),
    ("duration_seconds", _FLOAT),
    ("validation_report", VALIDATION_REPORT),
    ("success", _FLAG),
)
SCORING_RESULT = _fields(
    ("task_success", _FLAG),
    ("verification_passed", _FLAG),
    ("regression_detected", _FLAG),
    ("compliance_score", _INT),
    ("iterations_required", _INT),
    ("bytes_changed", _INT),
    ("runtime_seconds", _FLOAT),
    ("tokens_used", _INT),
    ("model", _TEXT),
    ("task_id", _TEXT),
    ("timestamp", _TEXT),
    ("model_output_length", _INT),
    ("error_type", _TEXT),
)
RUN_ARTIFACTS = _fields(
    ("run_id", _TEXT),
    ("original_template_hash", _TEXT),
    ("modified_template_hash", _TEXT),
    ("reference_solution_hash", _TEXT),
    ("validation_report_path", _TEXT),
)
#: A run as the run store keeps it, whole.
RUN_RECORD = _fields(
    ("run_id", _TEXT),
    ("timestamp", _TEXT),
    ("task_id", _TEXT),
    ("task_name", _TEXT),
    ("model_name", _TEXT),
    ("execution_attempts", T.ArrayType(EXECUTION_ATTEMPT)),
    ("scoring", SCORING_RESULT),
    ("artifacts", RUN_ARTIFACTS),
    ("runtime_logs", _TEXT),
    ("notes", _TEXT),
)

JSON_ANSWER = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("file_path", T.StringType()),
    ]
)
SYNTAX_AUDIT = T.StructType(
    [
        T.StructField("passed", T.BooleanType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("lines_of_code", T.IntegerType()),
        T.StructField("import_roots", T.ArrayType(T.StringType())),
    ]
)
DIFF_STATS = T.StructType(
    [
        T.StructField("lines_changed", T.IntegerType()),
        T.StructField("lines_added", T.IntegerType()),
        T.StructField("lines_deleted", T.IntegerType()),
        T.StructField("diff_lines", T.IntegerType()),
        T.StructField("original_line_count", T.IntegerType()),
        T.StructField("modified_line_count", T.IntegerType()),
    ]
)
