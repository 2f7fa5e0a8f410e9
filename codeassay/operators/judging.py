"""Attempts judged by the code they wrote: staged, gated evaluation of whole runs.

An answer is extracted, scored and audited once, where it is scanned; from there on a narrow record of
it moves. Code that nobody wrote is not parsed, imports are looked at only where the syntax
passed, and test verdicts count only behind both. The records and the folded test
verdicts of a run meet in one clustering by run, in which the file that each attempt leaves behind,
the first success, the final attempt and the regression check are one sorted pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeassay.functions.arrow_udfs import syntax_verdict, syntax_verdict_udf
from codeassay.functions.text import read_back, settle, text_of
from codeassay.operators.diffs import KEY, with_content
from codeassay.operators.scoring import content_score, rule_weights
from codeassay.operators.skew import lookup_join
from codeassay.operators.validation import NO_TESTS, PASSED, regression_details, verdict_code, verdict_columns
from codeassay.schemas import DEFAULT_RULES, REPORT_STAGES, SIGNATURE, SPEC_DEFAULTS

MAX_ITERATIONS = SPEC_DEFAULTS["max_iterations"]
SUBJECTS = ("modified", "reference", "rerun")


def task_rules(task_specs: DataFrame) -> DataFrame:
    """One row per task of parsed specs: name, attempt limit, signature text and rule weights."""
    return rule_weights(task_specs, F.col("name").alias("task_name"), F.col("max_iterations").alias("task_limit"))


def within_limits(attempts: DataFrame, tasks: DataFrame | None = None, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Attempts that their task's limit lets run, with the columns of ``tasks`` (``task_rules``) joined.

    An attempt whose task has no valid specification stays, under ``max_iterations``.
    """
    if tasks is None:
        return attempts.filter(F.col("iteration") <= max_iterations)
    joined = lookup_join(attempts, tasks, "task_id", "left", KEY, census=attempts.select("task_id"))
    return joined.filter(F.col("iteration") <= F.coalesce("task_limit", F.lit(max_iterations)))


def _audit(allowed: Iterable[str], verdict: Column) -> dict[str, Column]:
    """Both audits of one parse: the imports of code that doesn't parse are never looked at."""
    names = F.array(*[F.lit(n) for n in sorted(set(allowed))])
    foreign = F.filter(F.coalesce(verdict["import_roots"], F.array().cast("array<string>")), lambda m: ~F.array_contains(names, m))
    return {
        "syntax": F.coalesce(verdict["passed"], F.lit(False)),
        "syntax_message": verdict["error_message"],
        "line_number": verdict["line_number"],
        "lines_of_code": verdict["lines_of_code"],
        "missing": F.when(verdict["passed"], F.try_element_at(foreign, F.lit(1))),
    }


def _template_audit(allowed: Iterable[str], template: str) -> Column:
    """What ``_audit`` says of the template, which is one text for all rows."""
    v = syntax_verdict(template)
    missing = next((m for m in v["import_roots"] if m not in set(allowed)), None) if v["passed"] else None
    return F.struct(
        F.lit(len(template)).alias("chars"),
        F.lit(v["passed"]).alias("syntax"),
        F.lit(v["error_message"]).alias("syntax_message"),
        F.lit(v["line_number"]).cast("int").alias("line_number"),
        F.lit(v["lines_of_code"]).cast("int").alias("lines_of_code"),
        F.lit(missing).cast("string").alias("missing"),
    )


def measured(attempts: DataFrame, template: str, allowed: Iterable[str]) -> DataFrame:
    """A narrow record of each attempt: no text leaves the scan.

    ``attempts`` come from ``within_limits``. ``own`` is null where the attempt wrote nothing. ``start_score`` is the
    compliance of the template under the attempt's rules.
    """
    ruled = "task_limit" in attempts.columns
    signature = F.coalesce("signature", F.lit(SIGNATURE)) if ruled else F.lit(SIGNATURE)
    weights = {r: F.coalesce(f"w_{r}", F.lit(w)) if ruled else F.lit(w) for r, (_, w, _) in DEFAULT_RULES.items()}
    content = F.col("content")
    parsed = with_content(attempts).withColumn("_verdict", syntax_verdict_udf(content))
    own = {
        "chars": F.length(read_back(content)),
        **_audit(allowed, F.col("_verdict")),
        "score": content_score(content, signature, weights),
        "hash": F.sha2(read_back(content), 256),
    }
    record = F.struct(*[c.alias(name) for name, c in own.items()])
    start = content_score(F.lit(template), signature, weights)
    settled = settle(
        parsed,
        {
            "own": F.when(content.isNotNull(), record),
            "chars": F.length(content),
            "output_length": F.length(text_of("output")),
            "start_score": start,
        },
    )
    kept = [c for c in ("timestamp", "task_name") if c in attempts.columns]
    return settled.select(*KEY, "task_id", "model", "duration_seconds", *kept, "own", "chars", "output_length", "start_score")


def attempt_verdicts(outcomes: DataFrame) -> DataFrame:
    """Test verdicts of each attempt, as codes: run_id, iteration, tests and one code per subject.

    ``outcomes``: run_id, iteration, subject, test_id, outcome. Subjects are the modified file, the reference
    solution and a rerun of the modified file beside it. One aggregation of integers, combined map-side.
    """
    def code(subject: str) -> Column:
        return F.min(F.when(F.col("subject") == subject, verdict_code()))

    return outcomes.groupBy(*KEY).agg(
        F.count_if(F.col("subject") == "modified").alias("tests"), *[code(s).alias(s) for s in SUBJECTS]
    )


def judged(records: DataFrame, verdicts: DataFrame, template: str, allowed: Iterable[str]) -> DataFrame:
    """One row per executed attempt with its report, regression check and the scores so far.

    ``records`` come from ``measured``, ``verdicts`` from ``attempt_verdicts``. Both are brought to their run by one exchange. An
    attempt is judged by the file it leaves behind: its own code, else the last written version, else the template.
    Runs end at the first success; ``is_final`` marks the last attempt. The reference solution
    is looked at only behind three passed stages: it regressed if the reference passes its tests
    and the file fails them when they run again (the first verdict counts where there was no rerun).
    """
    none = F.lit(None)
    record_names = [c for c in records.columns if c not in KEY]
    verdict_names = ["tests", *SUBJECTS]
    rows = records.withColumns({n: none.cast(verdicts.schema[n].dataType) for n in verdict_names}).withColumn("_here", F.lit(True))
    folded = verdicts.select(*KEY, *[none.cast(records.schema[n].dataType).alias(n) for n in record_names], *verdict_names, none.cast("boolean").alias("_here"))
    # One exchange: rows of a run arrive together, and each later step needs no more than that.
    met = rows.unionByName(folded).repartition("run_id").groupBy(*KEY)
    one = met.agg(*[F.first(n, ignorenulls=True).alias(n) for n in [*record_names, *verdict_names, "_here"]]).filter("_here")

    run = Window.partitionBy("run_id").orderBy("iteration")
    until_now = run.rowsBetween(Window.unboundedPreceding, 0)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    base = _template_audit(allowed, template)
    carried = one.withColumns(
        {
            "_file": F.last("own", ignorenulls=True).over(until_now),
            "_old": F.last("own", ignorenulls=True).over(before),
            "runtime_seconds": F.round(F.sum("duration_seconds").over(until_now), 6),
        }
    )

    def of_file(name: str) -> Column:
        return F.when(F.col("_file").isNotNull(), F.col(f"_file.{name}")).otherwise(base[name])

    syntax, missing = of_file("syntax"), of_file("missing")
    tests = verdict_columns(F.when(F.coalesce("tests", F.lit(0)) > 0, F.col("modified")))
    stages = carried.withColumns(
        {
            "_syntax": syntax,
            "_imports": syntax & missing.isNull(),
            "_tests": syntax & missing.isNull() & tests["passed"],
        }
    )
    earlier = F.coalesce(F.max("_tests").over(before), F.lit(False))
    following = F.lead("iteration").over(run)
    ran = stages.withColumns({"_earlier": earlier, "_next": following}).filter(~F.col("_earlier"))

    def stage(name: str, passed: Column, error: Column, message: Column, details: Column) -> Column:
        return F.struct(
            F.lit(name).alias("stage"),
            passed.alias("passed"),
            F.when(~passed, error).alias("error_type"),
            F.when(~passed, message).otherwise(F.lit("")).alias("error_message"),
            details.alias("details"),
        )

    def details(**values: Column) -> Column:
        pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in values.items()]
        return F.map_from_entries(F.array_compact(F.array(*pairs)))

    reached = [F.lit(True), F.col("_syntax"), F.col("_imports")]
    listed = [
        stage(
            REPORT_STAGES[0], F.col("_syntax"), F.lit("syntax_error"), of_file("syntax_message"),
            details(lines_of_code=of_file("lines_of_code"), line_number=of_file("line_number")),
        ),
        stage(
            REPORT_STAGES[1], F.col("_imports"), F.lit("import_error"), F.concat(F.lit("Missing module: "), missing),
            details(missing_module=missing),
        ),
        stage(
            REPORT_STAGES[2], F.col("_tests"), tests["error_type"], tests["error_message"],
            details(tests=F.coalesce("tests", F.lit(0).cast("long"))),
        ),
    ]
    report = settle(ran, {"stages": F.array_compact(F.array(*[F.when(r, s) for r, s in zip(reached, listed, strict=True)]))})
    last = F.element_at("stages", -1)
    again = F.coalesce("rerun", "modified")
    regressed = F.col("_tests") & (F.coalesce("reference", F.lit(NO_TESTS)) == PASSED) & (again != PASSED)
    old_chars = F.when(F.col("_old").isNotNull(), F.col("_old.chars")).otherwise(F.lit(len(template)))
    return report.select(
        *KEY,
        *[c for c in records.columns if c not in (*KEY, "own", "chars", "start_score")],
        (F.col("_tests") | F.col("_next").isNull()).alias("is_final"),
        F.col("_tests").alias("success"),
        F.col("_tests").alias("verification_passed"),
        "stages",
        last["error_type"].alias("error_type"),
        last["error_message"].alias("error_message"),
        F.coalesce(regressed, F.lit(False)).alias("regression_detected"),
        F.when(regressed, regression_details(again)).otherwise(F.lit("")).alias("regression_details"),
        F.when(F.col("_file").isNotNull(), F.col("_file.score")).otherwise(F.col("start_score")).alias("compliance_score"),
        F.when(F.col("own").isNotNull(), F.abs(F.col("chars") - old_chars)).otherwise(F.lit(0)).alias("bytes_changed"),
        F.when(F.col("_old").isNotNull(), F.col("_old.hash")).otherwise(F.sha2(F.lit(template), 256)).alias("original_hash"),
        F.when(F.col("_file").isNotNull(), F.col("_file.hash")).otherwise(F.sha2(F.lit(template), 256)).alias("modified_hash"),
        "runtime_seconds",
    )


def judge(
    attempts: DataFrame,
    outcomes: DataFrame,
    template: str,
    allowed: Iterable[str],
    tasks: DataFrame | None = None,
    max_iterations: int = MAX_ITERATIONS,
) -> DataFrame:
    """From attempts and their test outcomes to one judged row per executed attempt (see ``judged``)."""
    disk = template.replace("\r\n", "\n").replace("\r", "\n")
    records = measured(within_limits(attempts, tasks, max_iterations), disk, allowed)
    return judged(records, attempt_verdicts(outcomes), disk, allowed)


def run_scores(judged_attempts: DataFrame, line_diffs: DataFrame | None = None) -> DataFrame:
    """One scoring row per run: that of its final attempt.

    ``line_diffs`` (run_id, iteration, lines_changed) adds the line measure of the final patch.
    """
    scored = judged_attempts.filter("is_final").select(
        "run_id",
        "task_id",
        "model",
        F.col("success").alias("task_success"),
        "verification_passed",
        "regression_detected",
        "compliance_score",
        F.col("iteration").alias("iterations_required"),
        "bytes_changed",
        "runtime_seconds",
        F.shiftright("output_length", 2).alias("tokens_used"),
        F.col("output_length").alias("model_output_length"),
        "error_type",
    )
    if line_diffs is None:
        return scored
    final = line_diffs.select("run_id", F.col("iteration").alias("iterations_required"), "lines_changed")
    return scored.join(final, ["run_id", "iterations_required"], "left").withColumn("lines_changed", F.coalesce("lines_changed", F.lit(0)))
