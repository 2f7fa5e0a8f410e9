"""The run store: whole run records with their reports, committed together, and a channel for broken lines.

A commit is one folder that one job writes: lines of kind ``result`` (a run's whole record) and of kind
``report`` (the report of its last attempt). Spark's commit protocol marks the folder when all its lines are
there, readers take marked folders only, and a commit that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codeassay.functions.text import settle
from codeassay.schemas import RUN_RECORD
from codeassay.session import hadoop_path

CORRUPT = "_corrupt"


def run_records(judged: DataFrame, attempts: DataFrame, reference: Column | None = None, notes: Column | None = None) -> DataFrame:
    """One whole record per run, with the columns of RUN_RECORD.

    ``judged`` has the executed attempts (``operators.judging``), ``attempts`` at least these with their
    ``output``, and none beyond the attempt limit: a run's arrays are as long as its attempts. Outputs and
    records meet in one aggregation by run, so each raw text moves once. ``reference`` is the text of the
    reference solution. Run ids are text in the record.
    """
    text = F.lit(None).cast("string")
    timestamp = F.col("timestamp") if "timestamp" in judged.columns else text
    name = F.col("task_name") if "task_name" in judged.columns else text
    report = F.struct(
        F.col("success").alias("overall_passed"),
        "stages",
        "regression_detected",
        "regression_details",
        F.col("original_hash").alias("original_template_hash"),
        F.col("modified_hash").alias("modified_template_hash"),
    )
    entry = F.struct(
        "iteration",
        timestamp.alias("timestamp"),
        "duration_seconds",
        report.alias("validation_report"),
        "success",
        *["is_final", "task_id", "model", name.alias("task_name"), "verification_passed", "compliance_score", "bytes_changed"],
        *["runtime_seconds", "output_length", "error_type"],
    )
    run_id = F.col("run_id").cast("string").alias("run_id")
    rows = judged.select(run_id, entry.alias("entry"))
    outputs = attempts.select(run_id, F.struct("iteration", F.coalesce("output", F.lit("")).alias("output")).alias("raw"))
    met = (
        rows.withColumn("raw", F.lit(None).cast(outputs.schema["raw"].dataType))
        .unionByName(outputs.withColumn("entry", F.lit(None).cast(rows.schema["entry"].dataType)))
        .groupBy("run_id")
        .agg(F.collect_list("entry").alias("entries"), F.map_from_entries(F.collect_list("raw")).alias("raws"))
        .filter(F.size("entries") > 0)
    )
    in_order = settle(met, {"ordered": F.array_sort("entries", lambda a, b: a["iteration"] - b["iteration"])})
    last = F.element_at("ordered", -1)
    scoring = F.struct(
        last["success"].alias("task_success"),
        last["verification_passed"].alias("verification_passed"),
        last["validation_report"]["regression_detected"].alias("regression_detected"),
        last["compliance_score"].alias("compliance_score"),
        last["iteration"].alias("iterations_required"),
        last["bytes_changed"].alias("bytes_changed"),
        last["runtime_seconds"].alias("runtime_seconds"),
        F.shiftright(last["output_length"], 2).alias("tokens_used"),
        last["model"].alias("model"),
        last["task_id"].alias("task_id"),
        last["timestamp"].alias("timestamp"),
        last["output_length"].alias("model_output_length"),
        last["error_type"].alias("error_type"),
    )
    first = F.element_at("ordered", 1)
    artifacts = F.struct(
        F.col("run_id").alias("run_id"),
        first["validation_report"]["original_template_hash"].alias("original_template_hash"),
        last["validation_report"]["modified_template_hash"].alias("modified_template_hash"),
        (F.lit("") if reference is None else F.sha2(reference, 256)).alias("reference_solution_hash"),
        F.concat(F.lit("kind=report/run_id="), F.col("run_id")).alias("validation_report_path"),
    )
    attempt = lambda a: F.struct(
        a["iteration"].alias("iteration"),
        a["timestamp"].alias("timestamp"),
        F.element_at("raws", a["iteration"]).alias("model_output_raw"),
        a["duration_seconds"].alias("duration_seconds"),
        a["validation_report"].alias("validation_report"),
        a["success"].alias("success"),
    )
    return in_order.select(
        "run_id",
        last["timestamp"].alias("timestamp"),
        last["task_id"].alias("task_id"),
        last["task_name"].alias("task_name"),
        last["model"].alias("model_name"),
        F.transform("ordered", attempt).alias("execution_attempts"),
        scoring.alias("scoring"),
        artifacts.alias("artifacts"),
        F.lit("").alias("runtime_logs"),
        (text if notes is None else notes).alias("notes"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in RUN_RECORD])


def commit_runs(records: DataFrame, path: str, commit: str) -> None:
    """Write records and reports as one commit. The same commit again replaces what it wrote before."""
    last = F.element_at("execution_attempts", -1)["validation_report"]
    record = F.to_json(F.struct(*[f.name for f in RUN_RECORD]))
    report = F.to_json(F.struct("run_id", last.alias("validation_report")))
    lines = F.array(
        F.struct(F.lit("result").alias("kind"), record.alias("value")), F.struct(F.lit("report").alias("kind"), report.alias("value"))
    )
    by = ("kind", "task_id", "model_name")
    listed = records.select("task_id", "model_name", F.inline(lines))
    listed.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).text(_folder(path, commit))


def _folder(path: str, commit: str) -> str:
    return f"{path.rstrip('/')}/commit={commit}"


def commits(spark: SparkSession, path: str) -> list[str]:
    """Folders of the commits that are complete, by name."""
    fs, root = hadoop_path(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("commit=")]
    whole = [p.toString() for p in found if fs.exists(p.suffix("/_SUCCESS"))]
    return sorted(whole)


def _lines(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """commit, line and the record parsed from it; ``_corrupt`` has lines that are no record."""
    folders = commits(spark, path)
    if not folders:
        return spark.createDataFrame([], T.StructType([T.StructField("commit", T.StringType()), T.StructField("line", T.StringType()), T.StructField("record", T.StructType([*schema, T.StructField(CORRUPT, T.StringType())]))]))
    # commit, task and model are text, whatever they look like
    columns = "value string, commit string, kind string, task_id string, model_name string"
    lines = spark.read.schema(columns).option("basePath", path).text(folders).filter(F.col("kind") == kind)
    with_corrupt = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parsed = settle(lines, {"record": F.from_json("value", with_corrupt, options)})
    return parsed.select("commit", F.col("value").alias("line"), "record")


def _broken(record: str = "record") -> Column:
    return F.col(record)[CORRUPT].isNotNull() | F.col(record)["run_id"].isNull()


def read_runs(spark: SparkSession, path: str, run_id: str | int | None = None) -> DataFrame:
    """Whole run records of all complete commits, with the commit; broken lines are not among them.

    Fields that a record doesn't have are null, those that RUN_RECORD doesn't have are ignored.
    """
    good = _lines(spark, path, "result", RUN_RECORD).filter(~_broken())
    if run_id is not None:
        good = good.filter(F.col("record.run_id") == str(run_id))
    return good.select("commit", *[F.col(f"record.{f.name}") for f in RUN_RECORD])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The report of each run's last attempt."""
    report = RUN_RECORD["execution_attempts"].dataType.elementType["validation_report"]
    schema = T.StructType([RUN_RECORD["run_id"], report])
    return _lines(spark, path, "report", schema).filter(~_broken()).select("commit", "record.run_id", "record.validation_report")


def rejected_runs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of complete commits that are no run record: commit, line, reason."""
    reason = F.when(F.col(f"record.{CORRUPT}").isNotNull(), F.lit("malformed")).otherwise(F.lit("no run_id"))
    return _lines(spark, path, "result", RUN_RECORD).filter(_broken()).select("commit", "line", reason.alias("reason"))


def explode_records(records: DataFrame) -> DataFrame:
    """One row per attempt and stage."""
    attempt = records.select("run_id", "task_id", "model_name", F.explode("execution_attempts").alias("a"))
    stages = attempt.select(
        "run_id", "task_id", F.col("model_name").alias("model"), "a.iteration", "a.success", F.posexplode("a.validation_report.stages").alias("pos", "s")
    )
    return stages.select(
        "run_id", "task_id", "model", "iteration", "success", (F.col("pos") + 1).alias("stage_ord"), "s.stage", "s.passed", "s.error_type", "s.error_message"
    )
