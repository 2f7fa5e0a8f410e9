"""The query catalog: one named query per operator, each over whole derived corpora.

Array results are shown as '|'-joined text, so that engines need not agree on array hashing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeassay.operators import batch, diffs, extract, judging, report, runs, scoring, validation
from codeassay.plans import corpus
from codeassay.schemas import DEFAULT_RULES, RUN_ARTIFACTS, SCORING_RESULT
from codeassay.session import scratch_path
from codeassay.sources import records, registry, results, tasks
from codeassay.streaming import jobs, scoring as scoring_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(array: Column | str) -> Column:
    return F.concat_ws("|", array)


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(corpus.responses(spark, sf))


def _shown_summary(summary: DataFrame) -> DataFrame:
    modes = F.transform(
        F.map_entries("failure_modes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return summary.select(
        "total_runs",
        "compliant_rate",
        joined("registered_models").alias("registered_models"),
        "mean_score",
        joined(F.array_sort(modes)).alias("failure_modes"),
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with content; null where extraction failed."""
    return _extracted(spark, sf).withColumn("content", F.when(F.col("success"), F.col("content")))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    specs = tasks.parse_task_specs(corpus.specs(spark, sf))
    return judging.task_rules(specs.filter("status = 'valid'"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Executed attempts, judged by their own code, their tests and their task's limits and rules."""
    base = corpus.attempts(spark, sf)
    return judging.judge(base, corpus.attempt_tests(base), corpus.TEMPLATE, sys.stdlib_module_names, _tasks(spark, sf))


def _line_diffs(spark: SparkSession, sf: str) -> DataFrame:
    carried = diffs.carried_content(corpus.attempts(spark, sf), corpus.TEMPLATE)
    return diffs.diff_measures(carried).select("run_id", "iteration", "lines_changed")


def _clean_users(spark: SparkSession, sf: str) -> DataFrame:
    return report.cleaned(corpus.users(spark, sf))


# --- sources and sinks ------------------------------------------------------


@query
def spec_conformance(spark, sf):
    specs = tasks.parse_task_specs(corpus.specs(spark, sf))
    return specs.select(
        "folder",
        "status",
        joined("problems").alias("problems"),
        F.coalesce("id_mismatch", F.lit(False)).alias("id_mismatch"),
        "language",
        "max_iterations",
        "timeout_seconds",
        joined("validation_order").alias("validation_order"),
        F.coalesce(F.size("scoring_rules"), F.lit(0)).alias("n_rules"),
    )


@query
def task_structure_gaps(spark, sf):
    gaps = tasks.structure_gaps(corpus.task_files(spark, sf))
    return gaps.select("task", joined("missing_files").alias("missing_files"), "is_valid")


@query
def task_catalog(spark, sf):
    return tasks.available_tasks(corpus.task_files(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    task_rules = _tasks(spark, sf)
    kept = judging.within_limits(corpus.attempts(spark, sf), task_rules).select("run_id", "iteration", "output")
    return records.run_records(_judged(spark, sf), kept, F.lit(corpus.TEMPLATE))


@query
def attempt_explode(spark, sf):
    return records.explode_records(_records(spark, sf))


def _shown_attempts(runs_read: DataFrame) -> DataFrame:
    """Every field of whole run records, a row per attempt."""
    whole = runs_read.select("*", F.explode("execution_attempts").alias("a"))
    report = F.col("a.validation_report")
    shown = F.transform(
        report["stages"],
        lambda s: F.concat_ws(
            ",", s["stage"], s["passed"].cast("string"), F.coalesce(s["error_type"], F.lit("-")), s["error_message"],
            F.array_join(F.array_sort(F.transform(F.map_entries(s["details"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"),
        ),
    )
    return whole.select(
        "run_id",
        "timestamp",
        "task_id",
        "task_name",
        "model_name",
        "a.iteration",
        F.col("a.timestamp").alias("attempt_timestamp"),
        F.sha2("a.model_output_raw", 256).alias("output_sha256"),
        "a.duration_seconds",
        "a.success",
        report["overall_passed"].alias("overall_passed"),
        joined(shown).alias("stages"),
        report["regression_detected"].alias("regression_detected"),
        report["regression_details"].alias("regression_details"),
        report["original_template_hash"].alias("original_template_hash"),
        report["modified_template_hash"].alias("modified_template_hash"),
        *[F.col(f"scoring.{f}").alias(f"scored_{f}") for f in SCORING_RESULT.names],
        *[F.col(f"artifacts.{f}").alias(f"artifact_{f}") for f in RUN_ARTIFACTS.names],
        "runtime_logs",
        "notes",
    )


@query
def run_results_roundtrip(spark, sf):
    """Whole records written and read back, each field compared."""
    path = scratch_path(spark, "runs")
    records.commit_runs(_records(spark, sf), path, "c1")
    return _shown_attempts(records.read_runs(spark, path))


@query
def run_reports_roundtrip(spark, sf):
    """The reports that are committed beside the records."""
    path = scratch_path(spark, "runs")
    records.commit_runs(_records(spark, sf), path, "c1")
    report = F.col("validation_report")
    return records.read_reports(spark, path).select(
        "run_id",
        report["overall_passed"].alias("overall_passed"),
        F.size(report["stages"]).alias("stages"),
        report["regression_details"].alias("regression_details"),
        report["modified_template_hash"].alias("modified_template_hash"),
    )


@query
def run_results_rejects(spark, sf):
    """Broken lines of a store, next to good ones, which stay readable."""
    path = scratch_path(spark, "runs")
    lines = corpus.table(spark, sf, "documents").selectExpr(*corpus.RUN_LINES)
    lines.write.partitionBy("kind", "task_id", "model_name").text(f"{path}/commit=c1")
    good = records.read_runs(spark, path).select("run_id", F.lit(None).cast("string").alias("line"), F.lit("good").alias("status"))
    bad = records.rejected_runs(spark, path).select(F.lit(None).cast("string").alias("run_id"), "line", F.col("reason").alias("status"))
    return good.unionByName(bad)


@query
def batch_results_roundtrip(spark, sf):
    path = scratch_path(spark, "batch")
    results.write_batch_results(corpus.responses(spark, sf), path, "b1")
    back = results.read_batch_runs(spark, path, "b1")
    return back.select("batch_id", "response_id", "run", "model", "score", joined("failure_modes").alias("failure_modes"))


@query
def batch_summary_roundtrip(spark, sf):
    path = scratch_path(spark, "batch")
    rows = corpus.responses(spark, sf)
    results.write_batch_results(rows, path, "b1")
    schema = batch.batch_summary(rows).select(F.lit("b1").alias("batch_id"), "*").schema
    return _shown_summary(results.read_batch_summary(spark, path, "b1", schema))


@query
def content_fingerprint(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    return docs.select("doc_id", results.fingerprint("text").alias("sha256"))


@query
def file_fingerprints(spark, sf):
    """Hashes of files that hold a hundred documents each, half of them read in pieces."""
    path = scratch_path(spark, "files")
    texts = corpus.table(spark, sf, "documents").selectExpr("doc_id", "cast(floor(doc_id / 100) as int) as bucket", "coalesce(text, '') as text")
    texts.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text").write.partitionBy("bucket").text(path)
    median = F.expr("approx_percentile(length, 0.5)")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    hashed = results.file_fingerprints(spark, path, found.agg(median).first()[0] or 0, "*.txt")
    return hashed.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int").alias("bucket"), "sha256")


@query
def model_registry(spark, sf):
    """Registered models in order, with the responses of each; responses of others are not counted."""
    counts = corpus.responses(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("responses"))
    return registry.with_models(counts).select("ordinal", "name", F.coalesce("responses", F.lit(0).cast("long")).alias("responses"))


# --- extraction -------------------------------------------------------------


@query
def extract_json(spark, sf):
    answered = extract.json_answers(corpus.responses(spark, sf))
    return answered.filter("content is not null").select("response_id", "content", "file_path")


@query
def extract_fenced(spark, sf):
    boxed = extract.fenced(corpus.responses(spark, sf))
    return boxed.filter("content is not null").select("response_id", "content")


@query
def extract_cascade(spark, sf):
    return _extracted(spark, sf).select(
        "response_id", "success", "format", "content", "file_path", "extraction_error"
    )


@query
def format_mix(spark, sf):
    return extract.format_mix(corpus.responses(spark, sf))


# --- features and scores ----------------------------------------------------


@query
def compliance_features(spark, sf):
    checked = scoring.features(_answers(spark, sf).filter("success"))
    return checked.select("response_id", *DEFAULT_RULES)


@query
def failure_modes(spark, sf):
    marked = scoring.failure_modes(corpus.responses(spark, sf))
    return marked.select("response_id", joined("failure_modes").alias("failure_modes"))


@query
def rules_effective(spark, sf):
    specs = tasks.parse_task_specs(corpus.specs(spark, sf)).filter("status = 'valid'")
    return scoring.effective_rules(specs)


@query
def compliance_score(spark, sf):
    scored = scoring.compliance_score(_answers(spark, sf))
    return scored.select("response_id", "raw_score", "compliance_score")


@query
def compliance_score_by_task(spark, sf):
    """Each response scored under its own task's rules."""
    specs = tasks.parse_task_specs(corpus.specs(spark, sf)).filter("status = 'valid'")
    own_task = F.concat(F.lit("task_"), F.col("response_id").cast("string"))
    answers = _answers(spark, sf).withColumn("task_id", own_task).select("response_id", "task_id", "content")
    scored = scoring.compliance_score(answers, rules=scoring.rule_weights(specs), spread=["response_id"])
    return scored.select("response_id", "raw_score", "compliance_score")


@query
def quick_score(spark, sf):
    scored = scoring.quick_scores(corpus.responses(spark, sf))
    return scored.select("response_id", "score", "max_score", "normalized", "is_compliant")


@query
def compliance_issues(spark, sf):
    scored = scoring.quick_scores(corpus.responses(spark, sf))
    return scored.select("response_id", joined("compliance_issues").alias("compliance_issues"))


@query
def token_estimate(spark, sf):
    rows = corpus.prompted(spark, sf)
    return rows.select("response_id", scoring.token_estimate(F.col("prompt"), F.col("output")).alias("tokens"))


@query
def threshold_pass(spark, sf):
    scored = scoring.compliance_score(_answers(spark, sf))
    return scoring.passes_threshold(scored).select("response_id", "compliance_score")


# --- diffs ------------------------------------------------------------------


@query
def carry_forward_content(spark, sf):
    carried = diffs.carried_content(corpus.attempts(spark, sf), corpus.TEMPLATE)
    return carried.select("run_id", "iteration", "content_before")


@query
def patch_size(spark, sf):
    return diffs.patch_size(corpus.attempts(spark, sf), corpus.TEMPLATE)


@query
def lines_changed(spark, sf):
    carried = diffs.carried_content(corpus.attempts(spark, sf), corpus.TEMPLATE)
    return diffs.diff_measures(carried).select("run_id", "iteration", "lines_changed")


@query
def diff_summary(spark, sf):
    carried = diffs.carried_content(corpus.attempts(spark, sf), corpus.TEMPLATE)
    return diffs.diff_measures(carried).select(
        "run_id",
        "iteration",
        "lines_added",
        "lines_deleted",
        (F.col("lines_added") + F.col("lines_deleted")).alias("lines_touched"),
        "diff_lines",
    )


# --- validation -------------------------------------------------------------


@query
def syntax_audit(spark, sf):
    audited = validation.syntax_audit(corpus.programs(spark, sf))
    return audited.select(
        "response_id", "syntax_passed", "error_type", "error_message", "line_number", "lines_of_code"
    )


@query
def import_audit(spark, sf):
    audited = validation.syntax_audit(corpus.programs(spark, sf))
    checked = validation.import_audit(audited, sys.stdlib_module_names)
    return checked.select(
        "response_id",
        joined("import_roots").alias("import_roots"),
        joined("missing_modules").alias("missing_modules"),
        "imports_passed",
        "error_message",
    )


@query
def test_verdict(spark, sf):
    keys = corpus.responses(spark, sf).select("response_id")
    return validation.test_verdicts(corpus.test_outcomes(spark, sf), keys)


@query
def validation_pipeline(spark, sf):
    """From programs to reports: both audits and the tests of each program, composed."""
    key = (F.col("response_id").alias("run_id"), F.lit(1).alias("iteration"))
    programs = corpus.programs(spark, sf).select(*key, "content")
    verdicts = validation.test_verdicts(corpus.test_outcomes(spark, sf)).filter("subject = 'modified'")
    staged = validation.stage_results(programs, verdicts.select(*key, "*"), sys.stdlib_module_names)
    stages = F.transform("stages", lambda s: s["stage"])
    return validation.validation_reports(staged).select(
        "run_id", "overall_passed", "verification_passed", joined(stages).alias("stages"), "error_type", "error_message"
    )


@query
def validation_report(spark, sf):
    """Reports of executed attempts."""
    stages = F.transform("stages", lambda s: s["stage"])
    return _judged(spark, sf).select(
        "run_id", "iteration", F.col("success").alias("overall_passed"), "verification_passed",
        joined(stages).alias("stages"), "error_type", "error_message",
    )


@query
def regression_join(spark, sf):
    """Regressions of final attempts: looked for behind three passed stages only."""
    final = _judged(spark, sf).filter("is_final")
    return final.select("run_id", "iteration", "success", "regression_detected", "regression_details")


@query
def response_regressions(spark, sf):
    """Regressions of single responses with tests, whatever their stages say."""
    return validation.regressions(corpus.test_outcomes(spark, sf))


@query
def error_type_mix(spark, sf):
    return validation.error_type_mix(_judged(spark, sf).withColumnRenamed("success", "overall_passed"))


# --- runs -------------------------------------------------------------------


@query
def final_attempt(spark, sf):
    return _judged(spark, sf).filter("is_final").select("run_id", "iteration", "success", "error_type")


@query
def iterations_required(spark, sf):
    """Under each task's own limit."""
    final = _judged(spark, sf).filter("is_final")
    return final.select("run_id", F.col("iteration").alias("iterations_required"), F.col("success").alias("task_success"))


@query
def run_duration(spark, sf):
    return runs.run_duration(_judged(spark, sf), sys.maxsize)


@query
def run_scores(spark, sf):
    return judging.run_scores(_judged(spark, sf), _line_diffs(spark, sf))


@query
def leaderboard(spark, sf):
    return runs.leaderboard(judging.run_scores(_judged(spark, sf)))


@query
def prompt_assembly(spark, sf):
    """Prompts of the attempts that the loop runs."""
    ran = _judged(spark, sf).select("run_id", "iteration")
    base = corpus.attempts(spark, sf).join(ran, ["run_id", "iteration"], "left_semi")
    return runs.prompts(base, corpus.prompt_tasks(spark, sf)).select("run_id", "iteration", "prompt", "status")


@query
def recent_runs(spark, sf):
    turns = corpus.table(spark, sf, "conversations").filter("role = 'assistant'")
    return runs.recent_runs(turns.groupBy(F.col("conv_id").alias("run_id")).agg(F.max("turn").alias("turn")), 10)


# --- batch ------------------------------------------------------------------


@query
def evaluation_grid(spark, sf):
    """Grid cells up to the highest run seen, with the usable responses each has."""
    rows = corpus.responses(spark, sf)
    n_runs = rows.agg(F.max("run")).first()[0] or 0
    done = batch.without_errors(rows).groupBy("run", "model").agg(F.count(F.lit(1)).alias("responses"))
    return batch.evaluation_grid(spark, n_runs).join(done, ["run", "model"], "left").fillna(0)


@query
def missing_cells(spark, sf):
    """Cells of the grid up to the highest run seen that have no usable response."""
    rows = corpus.responses(spark, sf)
    n_runs = rows.agg(F.max("run")).first()[0] or 0
    return batch.unseen_cells(rows, n_runs)


@query
def error_exclusion(spark, sf):
    return batch.without_errors(corpus.responses(spark, sf)).select("response_id", "model", "run", "latency_ms")


@query
def compliance_rate(spark, sf):
    return batch.compliance_rate(batch.scored_batch(corpus.responses(spark, sf)))


@query
def score_distribution(spark, sf):
    return batch.score_distribution(batch.scored_batch(corpus.responses(spark, sf)))


@query
def failure_mode_distribution(spark, sf):
    return batch.failure_mode_distribution(corpus.responses(spark, sf))


@query
def batch_summary(spark, sf):
    summary = batch.batch_summary(corpus.responses(spark, sf))
    return _shown_summary(summary)


@query
def failure_category_rollup(spark, sf):
    return batch.failure_category_rollup(corpus.responses(spark, sf))


@query
def model_routing(spark, sf):
    requests = corpus.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, F.lit("llama3"))
        .when(F.col("event_id") % 4 == 1, F.col("event_type"))
        .alias("preferred"),
        F.col("user_id").alias("index"),
    )
    return batch.route_models(requests).select("event_id", "model")


# --- reports ----------------------------------------------------------------


@query
def report_valid_records(spark, sf):
    return report.valid_records(corpus.users(spark, sf)).select("tenant", "pos", "id", "name", "active")


@query
def report_dedup_first(spark, sf):
    first = report.keep_first(report.valid_records(corpus.users(spark, sf)))
    return first.select("tenant", "id", "pos", "name", "active")


@query
def report_required_fields(spark, sf):
    return _clean_users(spark, sf).select("tenant", "id", "pos", "name", "active")


@query
def report_counts(spark, sf):
    """Counts need no names, so none are read."""
    return report.counts(report.cleaned(corpus.users(spark, sf).drop("name")))


@query
def report_listing(spark, sf):
    return report.listing(_clean_users(spark, sf)).select("tenant", "is_active", "position", "pos", "name")


@query
def report_render(spark, sf):
    return report.render(report.report_lines(_clean_users(spark, sf)))


@query
def report_lines(spark, sf):
    return report.report_lines(_clean_users(spark, sf))


@query
def report_from_json(spark, sf):
    """Reports from raw JSON items, in which ids have every type."""
    return report.render(report.report_lines(report.cleaned(report.parse_users(corpus.raw_users(spark, sf)))))


@query
def report_degenerate(spark, sf):
    return report.reports(corpus.tenant_inputs(spark, sf), corpus.users(spark, sf))


# --- streaming --------------------------------------------------------------


@query
def response_scoring(spark, sf):
    scored = scoring_stream.score_responses(corpus.responses(spark, sf))
    return scored.withColumn("failure_modes", joined("failure_modes"))


@query
def stream_scoring(spark, sf):
    """The same scores, from a stream over the documents file into a Parquet sink."""
    arriving = corpus.table_stream(spark, sf, "documents")
    base = scratch_path(spark, "scores")
    scoring_stream.start_scoring_stream(
        arriving.selectExpr(*corpus.RESPONSES), f"{base}/table", f"{base}/log"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/table").withColumn("failure_modes", joined("failure_modes"))


def _shown_status(statuses: DataFrame) -> DataFrame:
    return statuses.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query
def job_latest_status(spark, sf):
    return _shown_status(jobs.latest_status(corpus.job_events(spark, sf)))


@query
def stream_job_status(spark, sf):
    """The same statuses, from a stream over the events file into a keyed table that is compacted."""
    arriving = corpus.table_stream(spark, sf, "events")
    base = scratch_path(spark, "status")
    jobs.start_status_table(arriving.selectExpr(*corpus.JOB_EVENTS), f"{base}/table", f"{base}/log", compact_every=1).awaitTermination()
    return _shown_status(jobs.read_status_table(spark, f"{base}/table"))
