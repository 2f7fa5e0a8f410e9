"""Verdict tables: syntax and import audits, test verdicts, first-failure reports, regressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from codeassay.functions.arrow_udfs import syntax_verdict_udf
from codeassay.functions.text import settle
from codeassay.schemas import ERROR_TYPES, REPORT_STAGES


def syntax_audit(programs: DataFrame, content: str = "content") -> DataFrame:
    """Parse each program. Null content stands for a missing file: patch_application_failed."""
    code = F.col(content)
    parsed = programs.withColumn("_v", syntax_verdict_udf(code))
    ok = F.coalesce(F.col("_v.passed"), F.lit(False))
    return settle(
        parsed,
        {
            "syntax_passed": ok,
            "error_type": F.when(code.isNull(), F.lit("patch_application_failed")).when(~ok, F.lit("syntax_error")),
            "error_message": F.when(code.isNull(), F.lit("File not found")).otherwise(F.col("_v.error_message")),
            "line_number": F.col("_v.line_number"),
            "lines_of_code": F.col("_v.lines_of_code"),
            "import_roots": F.col("_v.import_roots"),
        },
    ).drop("_v")


def import_audit(audited: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Imports stage of programs that passed syntax: roots outside ``allowed`` are missing modules.

    The allow-list is a fixed set of names, so it is a set-membership test and not a join.
    """
    names = sorted(set(allowed))
    missing = F.filter("import_roots", lambda m: ~m.isin(names))
    first = F.try_element_at(F.col("missing_modules"), F.lit(1))
    return (
        audited.filter("syntax_passed")
        .withColumn("missing_modules", missing)
        .withColumn("imports_passed", F.size("missing_modules") == 0)
        .withColumn("error_type", F.when(~F.col("imports_passed"), F.lit("import_error")))
        .withColumn("error_message", F.coalesce(F.concat(F.lit("Missing module: "), first), F.lit("")))
    )


# ---------------------------------------------------------------------------
# Test outcomes
# ---------------------------------------------------------------------------

# Fixed values. verdict code -> (error type, message); lower codes win within a set of outcomes
_VERDICTS = (
    ("runtime_crash", "Failed to execute pytest"),
    ("timeout", "Pytest execution timed out"),
    ("verification_failed", "One or more pytest tests failed"),
)
PASSED, NO_TESTS = len(_VERDICTS), len(_VERDICTS) + 1


def verdict_code() -> Column:
    outcome = F.col("outcome")
    return (
        F.when(outcome == "crash", F.lit(0))
        .when(outcome == "timeout", F.lit(1))
        .when(outcome == "passed", F.lit(PASSED))
        .otherwise(F.lit(2))
    )


def verdict_columns(code: Column) -> dict[str, Column]:
    """passed, error_type and error_message of a verdict code; a null code stands for no tests."""
    passed = F.coalesce(code == PASSED, F.lit(False))
    error, message = F.when(passed, F.lit(None).cast("string")), F.when(passed, F.lit(""))
    for at, (kind, text) in enumerate(_VERDICTS):
        error, message = error.when(code == at, F.lit(kind)), message.when(code == at, F.lit(text))
    return {
        "passed": passed,
        "error_type": error.otherwise(F.lit("verification_failed")),
        "error_message": message.otherwise(F.lit("Test directory not found")),
    }


def test_verdicts(outcomes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Fold per-test outcomes to one verdict per response and subject.

    The fold is a minimum over integer codes: combined map-side, one fixed-size buffer per key.
    ``keys`` (response_id) adds a verdict for responses whose modified code has no tests at all.
    """
    folded = (
        outcomes.groupBy("response_id", "subject")
        .agg(F.min(verdict_code()).alias("_code"), F.count(F.lit(1)).alias("tests"))
    )
    if keys is not None:
        bare = (
            keys.select("response_id")
            .join(folded.filter("subject = 'modified'"), "response_id", "left_anti")
            .select("response_id", F.lit("modified").alias("subject"), F.lit(None).cast("int").alias("_code"), F.lit(0).cast("long").alias("tests"))
        )
        folded = folded.unionByName(bare)
    return folded.withColumns(verdict_columns(F.col("_code"))).drop("_code")


def regression_details(modified: Column) -> Column:
    """What a report says of a regression, from the verdict code of the modified file."""
    return F.concat(
        F.lit("Reference solution passes tests but modified solution fails. Modified error: "),
        verdict_columns(modified)["error_message"],
    )


def regressions(outcomes: DataFrame) -> DataFrame:
    """Reference passed and modified failed on the same tests; one aggregation, no self-join.

    A response without reference outcomes is skipped (false).
    """
    def code(subject: str) -> Column:
        return F.min(F.when(F.col("subject") == subject, verdict_code()))

    folded = outcomes.groupBy("response_id").agg(
        code("reference").alias("_reference"), code("modified").alias("_modified")
    )
    modified = verdict_columns(F.col("_modified"))
    regressed = F.coalesce(F.col("_reference") == PASSED, F.lit(False)) & ~modified["passed"]
    return folded.select(
        "response_id",
        F.coalesce(F.col("_reference") == PASSED, F.lit(False)).alias("reference_passed"),
        modified["passed"].alias("modified_passed"),
        regressed.alias("regression_detected"),
        F.when(regressed, regression_details(F.col("_modified"))).otherwise(F.lit("")).alias("regression_details"),
    )


# ---------------------------------------------------------------------------
# Stage reports
# ---------------------------------------------------------------------------


def stage_results(programs: DataFrame, verdicts: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """The three stages of each attempt: run_id, iteration, stage, passed, error_type, error_message.

    ``programs``: run_id, iteration, content; ``verdicts``: run_id, iteration, passed, error_type,
    error_message of its tests. Code is parsed once for both audits, and its text stays where it is
    scanned: only verdicts are joined. An attempt without a test verdict has no tests and fails that
    stage. Stages behind a failure are listed as they would be; ``validation_reports`` cuts them off.
    """
    audited = syntax_audit(programs.select("run_id", "iteration", "content"))
    names = sorted(set(allowed))
    missing = F.filter(F.coalesce("import_roots", F.array().cast("array<string>")), lambda m: ~m.isin(names))
    slim = settle(audited, {"missing": missing}).drop("content", "import_roots")
    tested = verdicts.select(
        "run_id", "iteration", F.col("passed").alias("_p"), F.col("error_type").alias("_e"), F.col("error_message").alias("_m")
    )
    first = F.try_element_at(F.col("missing"), F.lit(1))
    none = F.lit(None).cast("string")

    def row(stage: str, passed: Column, error: Column, message: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"),
            passed.alias("passed"),
            F.when(~passed, error).otherwise(none).alias("error_type"),
            F.when(~passed, message).otherwise(F.lit("")).alias("error_message"),
        )

    untested = verdict_columns(F.lit(None).cast("int"))
    stages = F.array(
        row("syntax", F.col("syntax_passed"), F.col("error_type"), F.col("error_message")),
        row("imports", F.size("missing") == 0, F.lit("import_error"), F.concat(F.lit("Missing module: "), first)),
        row(
            "tests",
            F.coalesce(F.col("_p"), F.lit(False)),
            F.coalesce("_e", untested["error_type"]),
            F.coalesce("_m", untested["error_message"]),
        ),
    )
    return slim.join(tested, ["run_id", "iteration"], "left").select("run_id", "iteration", F.inline(stages))


def validation_reports(stage_results: DataFrame) -> DataFrame:
    """First-failure report per attempt: stages up to and including the first failure.

    With an ``error_message`` in the stages, the report has that of the failed stage ('' if none).

    Three stages give three fixed slots, so this is one hash aggregation over integers: no window
    and no collected list. Unknown error names decode to null.
    """
    names = F.array(*[F.lit(e) for e in ERROR_TYPES])
    error_code = F.nullif(F.array_position(names, F.col("error_type")), F.lit(0))
    slots = []
    for stage in REPORT_STAGES:
        here = F.col("stage") == stage
        slots.append(F.min(F.when(here, F.col("passed").cast("int"))).alias(f"_{stage}"))
        slots.append(F.min(F.when(here & ~F.col("passed"), error_code)).alias(f"_{stage}_error"))
        if "error_message" in stage_results.columns:
            slots.append(F.min(F.when(here & ~F.col("passed"), F.col("error_message"))).alias(f"_{stage}_message"))
    folded = stage_results.groupBy("run_id", "iteration").agg(*slots)

    reached, stages, error = F.lit(True), [], F.lit(None).cast("string")
    message = F.lit(None).cast("string")
    for stage in REPORT_STAGES:
        passed = F.col(f"_{stage}") == 1
        present = reached & F.col(f"_{stage}").isNotNull()
        own_error = F.when(~passed, F.try_element_at(names, F.col(f"_{stage}_error").cast("int")))
        entry = F.struct(F.lit(stage).alias("stage"), passed.alias("passed"), own_error.alias("error_type"))
        stages.append(F.when(present, entry))
        error = F.coalesce(error, F.when(present, own_error))
        if "error_message" in stage_results.columns:
            message = F.coalesce(message, F.when(present & ~passed, F.col(f"_{stage}_message")))
        reached = present & passed
    return folded.select(
        "run_id",
        "iteration",
        F.coalesce(reached, F.lit(False)).alias("overall_passed"),
        F.array_compact(F.array(*stages)).alias("stages"),
        error.alias("error_type"),
        *([F.coalesce(message, F.lit("")).alias("error_message")] if "error_message" in stage_results.columns else []),
    ).withColumn(
        "verification_passed", F.exists("stages", lambda s: (s["stage"] == "tests") & s["passed"])
    )


def error_type_mix(reports: DataFrame) -> DataFrame:
    """Failed reports per model and error type."""
    return (
        reports.filter(~F.col("overall_passed") & F.col("error_type").isNotNull())
        .groupBy("model", "error_type")
        .agg(F.count(F.lit(1)).alias("attempts"))
    )
