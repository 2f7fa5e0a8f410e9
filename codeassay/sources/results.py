"""Run-result and batch-result sources and sinks, and content fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codeassay.functions.text import text_of
from codeassay.operators.batch import observed_batch, observed_summary, scored_batch
from codeassay.schemas import RUN_RESULT
from codeassay.session import hadoop_path, stable


def assemble_runs(attempts: DataFrame) -> DataFrame:
    """Nested run results from executed attempts with stage reports.

    A run has at most ``max_iterations`` executed attempts, which bounds the collected array. Run
    ids are text in the record, whatever they are in ``attempts``.
    """
    attempt = F.struct("iteration", "duration_seconds", "success", "error_type", "stages")
    return attempts.groupBy(F.col("run_id").cast("string").alias("run_id"), "task_id", "model").agg(
        F.array_sort(F.collect_list(attempt)).alias("execution_attempts")
    )


def write_run_results(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Write nested run results as JSON, and each run's last report beside them.

    The runs are computed once; the reports come from the files just written to the shared folder.
    Rows are gathered by task and model, in pieces that adaptive execution splits where a task
    has many runs, so there are few files for each of them.
    """
    runs = stable(runs)
    last = F.element_at("execution_attempts", -1)
    reports = runs.select("run_id", "task_id", "model", last.alias("last_attempt"))
    by = ("task_id", "model")
    runs.hint("rebalance", *by).write.mode(mode).partitionBy(*by).json(f"{path}/results")
    reports.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(f"{path}/reports")


def read_run_results(spark: SparkSession, path: str, run_id: str | int | None = None) -> DataFrame:
    """Nested run results; a run that does not exist gives no rows, a broken record is an error."""
    runs = spark.read.schema(RUN_RESULT).option("mode", "FAILFAST").json(f"{path}/results")
    return runs if run_id is None else runs.filter(F.col("run_id") == str(run_id))


def explode_attempts(runs: DataFrame) -> DataFrame:
    """One row per attempt and stage."""
    return (
        runs.select("run_id", "task_id", "model", F.explode("execution_attempts").alias("a"))
        .select("run_id", "task_id", "model", "a.iteration", "a.success", F.posexplode("a.stages"))
        .select(
            "run_id",
            "task_id",
            "model",
            "iteration",
            "success",
            (F.col("pos") + 1).alias("stage_ord"),
            "col.stage",
            "col.passed",
            "col.error_type",
        )
    )


def write_batch_results(responses: DataFrame, path: str, batch_id: str) -> None:
    """Per-response rows as Parquet and the summary row as JSON, both under the batch id.

    Responses are scored once: the summary is observed while the rows are written. It is written last and
    tells that the batch is complete; a write that fails leaves none, and the same batch may be written again.
    """
    spark, folder = responses.sparkSession, f"{path}/batch_id={batch_id}"
    tag = F.lit(batch_id).alias("batch_id")
    fs, old = hadoop_path(spark, f"{folder}/summary")
    fs.delete(old, True)
    rows, seen = observed_batch(scored_batch(responses))
    rows.select(tag, "*").write.mode("overwrite").parquet(f"{folder}/runs")
    observed_summary(spark, seen).select(tag, "*").write.json(f"{folder}/summary")


def read_batch_runs(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/batch_id={batch_id}/runs")


def read_batch_summary(spark: SparkSession, path: str, batch_id: str, schema: T.StructType) -> DataFrame:
    """The summary row as written; ``schema`` is that of ``batch_summary`` with the batch id first."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/batch_id={batch_id}/summary")


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of UTF-8 text."""
    return F.sha2(text_of(text), 256)


#: Files up to this size are hashed whole by the built-in; larger ones are read in pieces of CHUNK bytes.
WHOLE_BYTES, CHUNK = 64 << 20, 4 << 20


def _streamed(files: DataFrame) -> DataFrame:
    """(path, sha256) of files read piece by piece through their file system, whatever their size."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                digest = hashlib.sha256()
                try:
                    system, inside = pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
                    with system.open_input_stream(inside, compression=None) as stream:
                        while piece := stream.read(CHUNK):
                            digest.update(piece)
                    found = digest.hexdigest()
                except OSError:
                    found = ""
                yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [found]})

    return files.mapInArrow(rows, "path string, sha256 string")


def _streamable(path: str) -> bool:
    """Whether tasks can open the path without Spark."""
    try:
        pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (OSError, ValueError):
        return False
    return True


def file_fingerprints(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, name: str = "*") -> DataFrame:
    """SHA-256 of every file below ``path`` with such a name; a file that cannot be read has an empty one.
    Spark's listing leaves files without bytes out.

    Files up to ``whole_bytes`` are hashed in the JVM. Each larger one is a stream in one task, which holds
    a piece of it at a time; there are as many tasks as such files ask for by their bytes. In a store
    that only Spark's readers know, all files are hashed whole, up to the 2 GB that an array holds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    small = files.filter(F.col("length") <= whole_bytes)
    large = files.filter(F.col("length") > whole_bytes).select("path", "length")
    n, total = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    whole = [F.col("path"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256")]
    hashed = small.select(*whole)
    if not n:
        return hashed
    if not _streamable(large.first()["path"]):
        return files.select(*whole)
    tasks = max(1, min(n, -(-total // max(whole_bytes, 1))))
    return hashed.unionByName(_streamed(large.repartition(tasks, "path").select("path")))
