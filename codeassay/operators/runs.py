"""Reduction of attempts to runs, run scores, leaderboard and prompts.

A run never executes more than ``max_iterations`` attempts, and ``(run_id, iteration)`` is a key.
Dropping later rows first therefore bounds every per-run window below to ``max_iterations`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeassay.functions.text import read_back, text_of
from codeassay.operators.diffs import KEY, carried_content, with_content
from codeassay.operators.scoring import attach_rules, content_score
from codeassay.operators.skew import lookup_join
from codeassay.schemas import SPEC_DEFAULTS

MAX_ITERATIONS = SPEC_DEFAULTS["max_iterations"]


def executed(attempts: DataFrame, max_iterations: int | Column = MAX_ITERATIONS) -> DataFrame:
    """Attempts that the retry loop runs: up to the first success or ``max_iterations``.

    Expects a ``success`` column. Adds ``final_iteration``.
    """
    limit = F.lit(max_iterations) if isinstance(max_iterations, int) else max_iterations
    run = Window.partitionBy("run_id")
    first_success = F.min(F.when(F.col("success"), F.col("iteration"))).over(run)
    last = F.max("iteration").over(run)
    return (
        attempts.filter(F.col("iteration") <= limit)
        .withColumn("final_iteration", F.coalesce(first_success, last))
        .filter("iteration <= final_iteration")
    )


def final_attempts(attempts: DataFrame, max_iterations: int | Column = MAX_ITERATIONS) -> DataFrame:
    """The last executed attempt of each run."""
    return executed(attempts, max_iterations).filter("iteration = final_iteration").drop("final_iteration")


def iterations_required(attempts: DataFrame, max_iterations: int | Column = MAX_ITERATIONS) -> DataFrame:
    """First success, else the number executed. Pure aggregation, combined map-side."""
    return (
        attempts.filter(F.col("iteration") <= max_iterations)
        .groupBy("run_id")
        .agg(
            F.coalesce(F.min(F.when(F.col("success"), F.col("iteration"))), F.max("iteration")).alias(
                "iterations_required"
            ),
            F.bool_or("success").alias("task_success"),
        )
    )


def run_duration(attempts: DataFrame, max_iterations: int | Column = MAX_ITERATIONS) -> DataFrame:
    """Wall time when attempts carry ``ts``, else the sum of executed attempt durations."""
    measure = (
        (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double"))
        if "ts" in attempts.columns
        else F.sum("duration_seconds")
    )
    return (
        executed(attempts, max_iterations)
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("attempts"), F.round(measure, 6).alias("runtime_seconds"))
    )


def with_reports(attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """Attach stage reports; an attempt without one has failed."""
    return (
        attempts.join(reports, KEY, "left")
        .withColumn("success", F.coalesce("overall_passed", F.lit(False)))
        .withColumn("verification_passed", F.coalesce("verification_passed", F.lit(False)))
        .drop("overall_passed")
    )


def run_scores(
    attempts: DataFrame,
    reports: DataFrame,
    regressed: DataFrame,
    template: str,
    rules: DataFrame | None = None,
    line_diffs: DataFrame | None = None,
    max_iterations: int | Column = MAX_ITERATIONS,
) -> DataFrame:
    """One scoring row per run.

    Compliance is that of the file after the final attempt, so an empty final answer is scored on
    the version before it. Every text is scored where it is scanned; only its score and
    length travel with the run. ``regressed`` is keyed by run_id. ``line_diffs`` (run_id, iteration,
    lines_changed) adds the line measure of the final patch.
    """
    content = F.col("content")
    joined, signature, weights = attach_rules(with_content(attempts), rules, KEY)
    measured = joined.select(
        *KEY,
        "task_id",
        "model",
        "duration_seconds",
        F.length(text_of("output")).alias("_output_length"),
        F.length(content).alias("_chars"),
        F.when(
            content.isNotNull(),
            F.struct(
                F.length(read_back(content)).alias("chars"),
                content_score(content, signature, weights).alias("score"),
            ),
        ).alias("_own"),
        content_score(F.lit(template), signature, weights).alias("_start_score"),
    )
    runs = executed(with_reports(measured, reports), max_iterations)
    run = Window.partitionBy("run_id").orderBy("iteration")
    until_now = run.rowsBetween(Window.unboundedPreceding, 0)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    state = runs.withColumns(
        {
            "_now": F.last("_own", ignorenulls=True).over(until_now),
            "_old": F.last("_own", ignorenulls=True).over(before),
            "runtime_seconds": F.round(F.sum("duration_seconds").over(until_now), 6),
        }
    ).filter("iteration = final_iteration")
    old_chars = F.coalesce(F.col("_old.chars"), F.length(read_back(F.lit(template))))
    scored = state.join(regressed.select("run_id", "regression_detected"), "run_id", "left").select(
        "run_id",
        "task_id",
        "model",
        F.col("success").alias("task_success"),
        "verification_passed",
        F.coalesce("regression_detected", F.lit(False)).alias("regression_detected"),
        F.coalesce(F.col("_now.score"), F.col("_start_score")).alias("compliance_score"),
        F.col("final_iteration").alias("iterations_required"),
        F.when(F.col("_own").isNotNull(), F.abs(F.col("_chars") - old_chars)).otherwise(F.lit(0)).alias("bytes_changed"),
        "runtime_seconds",
        F.shiftright("_output_length", 2).alias("tokens_used"),
        F.col("_output_length").alias("model_output_length"),
        F.when(~F.col("success"), F.col("error_type")).alias("error_type"),
    )
    if line_diffs is None:
        return scored
    final = line_diffs.select("run_id", F.col("iteration").alias("iterations_required"), "lines_changed")
    return scored.join(final, ["run_id", "iterations_required"], "left").withColumn(
        "lines_changed", F.coalesce("lines_changed", F.lit(0))
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Tracked metrics per task and model: bounded aggregates only."""
    def rate(flag: str) -> Column:
        return F.round(F.avg(F.col(flag).cast("int")), 6)

    return scores.groupBy("task_id", "model").agg(
        F.count(F.lit(1)).alias("runs"),
        rate("task_success").alias("success_rate"),
        rate("verification_passed").alias("verification_rate"),
        rate("regression_detected").alias("regression_rate"),
        F.round(F.avg("compliance_score"), 6).alias("mean_compliance"),
        F.round(F.avg("iterations_required"), 6).alias("mean_iterations"),
        F.round(F.avg("runtime_seconds"), 6).alias("mean_runtime"),
        F.sum("bytes_changed").cast("long").alias("bytes_changed"),
        F.sum("tokens_used").cast("long").alias("tokens_used"),
    )


def _bullets(items: str) -> Column:
    listed = F.coalesce(F.col(items), F.array().cast("array<string>"))
    return F.array_join(F.transform(listed, lambda c: F.concat(F.lit("  - "), c)), "\n")


def prompts(attempts: DataFrame, task_specs: DataFrame) -> DataFrame:
    """The model input of each attempt, from its task and the code current before it.

    ``task_specs``: task_id, name, objective, constraints, rules, expected_behavior,
    template_text, reference_text. From the second iteration on the reference solution is shown.
    An attempt whose task has no specification stays, with a null prompt and status "no_task".
    """
    # the task's long texts join last, so they never pass through the carry-forward shuffles
    carried = carried_content(attempts, F.lit(None).cast("string"))
    known = task_specs.withColumn("_known", F.lit(True))
    current = lookup_join(carried, known, "task_id", "left", spread=KEY, census=attempts.select("task_id"))
    shows_reference = (F.col("iteration") > 1) & (text_of("reference_text") != "")
    reference = F.when(
        shows_reference,
        F.concat(
            F.lit("REFERENCE SOLUTION (for iteration "),
            F.col("iteration").cast("string"),
            F.lit("):\n```python\n"),
            read_back(F.col("reference_text")),
            F.lit("\n```\n"),
        ),
    ).otherwise(F.lit(""))
    # Fixed text of the prompt.
    lines = [
        F.lit("You are an expert Python developer. Your task is to refactor and fix code."),
        F.lit(""),
        F.concat(F.lit("TASK: "), text_of("name")),
        F.concat(F.lit("OBJECTIVE: "), text_of("objective")),
        F.lit("\nCONSTRAINTS:"),
        _bullets("constraints"),
        F.lit("\nRULES:"),
        _bullets("rules"),
        F.lit("\nCURRENT CODE:\n```python"),
        F.coalesce("content_before", read_back(F.col("template_text")), F.lit("")),
        F.lit("```\n\nEXPECTED BEHAVIOR:"),
        text_of("expected_behavior"),
        F.lit(""),
        reference,
        F.lit(""),
        F.lit("OUTPUT INSTRUCTIONS:"),
        F.lit("1. Return ONLY the complete, corrected Python code."),
        F.lit("2. Wrap your code in ```python``` markers."),
        F.lit("3. Do NOT include any explanation or comments outside the code block."),
        F.lit("4. Ensure the code is syntactically correct and passes all requirements."),
        F.lit(""),
    ]
    known = F.col("_known").isNotNull()
    return current.select(
        *KEY,
        "task_id",
        "model",
        F.when(known, F.concat_ws("\n", *lines)).alias("prompt"),
        F.when(known, "ok").otherwise("no_task").alias("status"),
    )


def recent_runs(runs: DataFrame, limit: int | None = 10, by: str | None = None) -> DataFrame:
    """Run ids of a table with one row per run, by descending name, or by a column such as a timestamp."""
    name = F.col("run_id").cast("string")
    ordered = runs.orderBy(*([F.desc(by)] if by else []), name.desc())
    return (ordered.limit(limit) if limit else ordered).select("run_id")
