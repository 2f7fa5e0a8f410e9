"""Rows, files and keys that must not get lost."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeassay.operators import runs, skew
from codeassay.sources import results, tasks


def touch(path, text=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_folders_named_like_the_root(spark, tmp_path):
    root = tmp_path / "tasks"
    for path in ("task_01/tasks/x.py", "task_01/spec.json", "task_02/tests/tasks/deep/t.py", "task_03/tasks"):
        touch(str(root / path), "{}")
    for given in (str(root), f"{root}/", f"file://{root}"):
        found = {tuple(r) for r in tasks.list_task_files(spark, given).collect()}
        assert found == {("task_01", "tasks"), ("task_01", "spec.json"), ("task_02", "tests"), ("task_03", "tasks")}


def test_one_task_is_read_alone(spark, tmp_path):
    spec = {"task_id": "t[1]", "name": "n", "category": "c", "difficulty": "d", "workflow": "w"}
    touch(str(tmp_path / "t[1]" / "spec.json"), json.dumps(spec))
    touch(str(tmp_path / "other" / "spec.json"), json.dumps({**spec, "task_id": "other"}))
    found = tasks.load_task(spark, str(tmp_path), "t[1]")
    assert [r.folder for r in found.collect()] == ["t[1]"]
    read = found._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in read
    assert tasks.load_task(spark, str(tmp_path), "absent").count() == 0


def test_text_run_ids(spark, tmp_path):
    stages = [("syntax", True, None)]
    rows = [("3f0e-aa", "t1", "m", i, 1.0, True, None, stages) for i in (1, 2)] + [("77", "t2", "m", 1, 2.0, False, "x", stages)]
    schema = (
        "run_id string, task_id string, model string, iteration int, duration_seconds double, success boolean, error_type string, "
        "stages array<struct<stage:string,passed:boolean,error_type:string>>"
    )
    nested = results.assemble_runs(spark.createDataFrame(rows, schema))
    path = str(tmp_path / "runs")
    results.write_run_results(nested, path)
    back = results.read_run_results(spark, path)
    key = lambda r: (r.run_id, r.task_id, r.model, str(r.execution_attempts))
    assert sorted(map(key, back.collect())) == sorted(map(key, nested.collect()))
    assert [r.run_id for r in results.read_run_results(spark, path, "3f0e-aa").collect()] == ["3f0e-aa"]
    assert results.read_run_results(spark, path, 77).count() == 1
    files = [f for _, _, names in os.walk(f"{path}/results") for f in names if f.endswith(".json")]
    assert len(files) == 2


def test_a_broken_record_is_an_error(spark, tmp_path):
    touch(str(tmp_path / "results" / "a.json"), '{"run_id": "a", "execution_attempts": [\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read_run_results(spark, str(tmp_path)).collect()


def test_attempts_without_a_task_keep_their_rows(spark):
    attempts = spark.createDataFrame(
        [(1, "known", "m", 1, "```python\nx = 1\n```"), (2, "lost", "m", 1, ""), (3, None, "m", 1, "")],
        "run_id long, task_id string, model string, iteration int, output string",
    )
    specs = spark.createDataFrame(
        [("known", "n", "o", ["c"], ["r"], "e", "t", "ref")],
        "task_id string, name string, objective string, constraints array<string>, rules array<string>, "
        "expected_behavior string, template_text string, reference_text string",
    )
    got = {r.run_id: r for r in runs.prompts(attempts, specs).collect()}
    assert got.keys() == {1, 2, 3}
    assert got[1].status == "ok" and "TASK: n" in got[1].prompt
    assert [(got[k].status, got[k].prompt) for k in (2, 3)] == [("no_task", None)] * 2


def test_wide_columns_count_towards_a_broadcast(spark):
    big = spark.range(1).select(
        F.lit("x" * 2000).cast("binary").alias("b"),
        F.parse_json(F.lit(json.dumps({"k": "y" * 2000}))).alias("v"),
    )
    for column in ("b", "v"):
        assert not skew.fits_broadcast(big.select(column), 1000)
        assert skew.fits_broadcast(big.select(column), 4000)
