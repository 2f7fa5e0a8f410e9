"""Task-spec source and task catalog."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeassay.functions.text import settle
from codeassay.schemas import (
    DEFAULT_VALIDATION_ORDER,
    REQUIRED_SPEC_FIELDS,
    REQUIRED_TASK_FILES,
    SCORING_RULES,
    SPEC_DEFAULTS,
)

_INTEGER_FIELDS = ("execution_config.max_iterations", "execution_config.timeout_seconds", "evaluation.max_score")
_TEXT_FIELDS = (
    "language",
    "entry_file",
    "expected_behavior",
    "research_signal",
    "notes",
    "execution_config.test_command",
    "evaluation.method",
    "evaluation.compliance_threshold",
)
_OBJECT_FIELDS = (
    "execution_config",
    "evaluation",
    "evaluation.scoring_rules",
    "model_instructions",
    "expected_properties",
    "verification",
)


def _text_field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "string")


def _kind(doc: Column, path: str) -> Column:
    """Type name of a field, null when the field is absent, 'VOID' for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant"))


def parse_task_specs(specs: DataFrame, text: str = "spec_text", folder: str = "folder") -> DataFrame:
    """Parse spec documents natively; ``status`` is 'valid' or 'reject' with ``problems``.

    Required fields must be JSON strings. Absent optional fields take their defaults; present ones must
    have their type. Unknown keys
    survive in ``spec`` (variant). A folder differing from the spec's id is only flagged.
    """
    doc = F.col("spec")
    parsed = settle(specs, {"spec": F.try_parse_json(F.col(text))})
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))

    def default(path: str, name: str, cast: str = "string") -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.{path}", cast), F.lit(SPEC_DEFAULTS[name]))

    def integer_problem(path: str) -> Column:
        present = _kind(doc, path).isNotNull()
        number = F.try_variant_get(doc, f"$.{path}", "double")
        whole = F.coalesce(number == F.floor(number), F.lit(False))
        return F.when(present & ~whole, F.lit(f"invalid:{path}"))

    field_problems = [
        F.when(_kind(doc, f).isNull(), F.lit(f"missing:{f}")).when(_kind(doc, f) != "STRING", F.lit(f"invalid:{f}"))
        for f in REQUIRED_SPEC_FIELDS
    ]
    field_problems += [integer_problem(path) for path in _INTEGER_FIELDS]
    field_problems += [F.when(_kind(doc, f) != "STRING", F.lit(f"invalid:{f}")) for f in _TEXT_FIELDS]
    field_problems += [
        F.when(~F.startswith(_kind(doc, f), F.lit("OBJECT")), F.lit(f"invalid:{f}")) for f in _OBJECT_FIELDS
    ]
    stages = "execution_config.validation_order"
    field_problems.append(
        F.when(~_kind(doc, stages).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"invalid:{stages}"))
    )
    problems = (
        F.when(doc.isNull(), F.array(F.lit("invalid_json")))
        .when(~is_object, F.array(F.lit("not_an_object")))
        .otherwise(F.array_compact(F.array(*field_problems)))
    )
    order = F.try_variant_get(doc, "$.execution_config.validation_order", "array<string>")
    rules = F.from_json(
        F.to_json(F.try_variant_get(doc, "$.evaluation.scoring_rules", "variant")), SCORING_RULES
    )
    judged = settle(parsed, {"problems": problems})
    valid = F.size("problems") == 0
    status = F.when(valid, F.lit("valid")).otherwise(F.lit("reject"))
    return judged.select(
        *specs.columns,
        status.alias("status"),
        "problems",
        *[_text_field(doc, f).alias(f) for f in REQUIRED_SPEC_FIELDS],
        (F.col(folder) != _text_field(doc, "task_id")).alias("id_mismatch"),
        default("language", "language").alias("language"),
        default("entry_file", "entry_file").alias("entry_file"),
        default("expected_behavior", "expected_behavior").alias("expected_behavior"),
        default("execution_config.max_iterations", "max_iterations", "int").alias("max_iterations"),
        default("execution_config.timeout_seconds", "timeout_seconds", "int").alias("timeout_seconds"),
        default("execution_config.test_command", "test_command").alias("test_command"),
        F.coalesce(order, F.array(*[F.lit(s) for s in DEFAULT_VALIDATION_ORDER])).alias("validation_order"),
        default("evaluation.method", "method").alias("method"),
        default("evaluation.max_score", "max_score", "int").alias("max_score"),
        default("evaluation.compliance_threshold", "compliance_threshold").alias("compliance_threshold"),
        rules.alias("scoring_rules"),
        _text_field(doc, "model_instructions.objective").alias("objective"),
        F.try_variant_get(doc, "$.model_instructions.constraints", "array<string>").alias("constraints"),
        F.try_variant_get(doc, "$.model_instructions.rules", "array<string>").alias("rules"),
        doc.alias("spec"),
    )


def _folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_task_specs(spark: SparkSession, tasks_dir: str, folders: str = "*") -> DataFrame:
    """Read every ``<tasks_dir>/<task>/spec.json``; ``folders`` is a pattern for the task."""
    files = spark.read.text(f"{tasks_dir.rstrip('/')}/{folders}/spec.json", wholetext=True)
    # The path of a file is percent-encoded, in which a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return parse_task_specs(
        files.select(_folder_of(path).alias("folder"), F.col("value").alias("spec_text"))
    )


def load_task(spark: SparkSession, tasks_dir: str, task_id: str) -> DataFrame:
    """The spec of one task; empty when it is absent or rejected.

    Only that task's folder is listed. Its name is matched literally, whatever it holds.
    """
    literal = re.sub(r"([\\*?\[\]{}])", r"\\\1", task_id)
    try:
        specs = read_task_specs(spark, tasks_dir, literal)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return parse_task_specs(spark.createDataFrame([], "folder string, spec_text string"))
    return specs.filter((F.col("folder") == task_id) & (F.col("status") == "valid"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as file sources report it, with scheme and without a slash at the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def list_task_files(spark: SparkSession, tasks_dir: str) -> DataFrame:
    """(task, file) for the files of every task folder; only names are read, not contents.

    A file below a subfolder counts as that subfolder, so ``tests`` exists when it holds a file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tasks_dir).select("path")
    below = F.col("path").substr(F.lit(len(_qualified(spark, tasks_dir)) + 2), F.length("path"))
    inside = F.split(below, "/")
    return (
        listed.filter(F.size(inside) >= 2)
        .select(inside[0].alias("task"), inside[1].alias("file"))
        .distinct()
    )


def available_tasks(task_files: DataFrame) -> DataFrame:
    """Folders holding a spec, sorted."""
    return task_files.filter("file = 'spec.json'").select("task").distinct().orderBy("task")


def structure_gaps(task_files: DataFrame) -> DataFrame:
    """Required files each task lacks; a valid task has none.

    One presence flag per required file in one aggregation: no join with the list of files.
    """
    present = [F.bool_or(F.col("file") == f).alias(f"_{i}") for i, f in enumerate(REQUIRED_TASK_FILES)]
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"_{i}"), F.lit(f)) for i, f in enumerate(REQUIRED_TASK_FILES)])
    )
    return task_files.groupBy("task").agg(*present).select(
        "task", missing.alias("missing_files"), (F.size(missing) == 0).alias("is_valid")
    )
