"""The run store: whole records, commits, broken lines."""

import json
import os

import pytest

from codeassay.operators import judging
from codeassay.schemas import RUN_RECORD
from codeassay.sources import records

TEMPLATE = "x = 0\n"
ATTEMPTS = "run_id string, iteration int, task_id string, model string, output string, duration_seconds double, timestamp string"
OUTCOMES = "run_id string, iteration int, subject string, test_id int, outcome string"


@pytest.fixture(scope="module")
def built(spark):
    attempts = [
        ("r-1", 1, "007", "m:1", "```\nx = (\n```", 1.0, "t1"), ("r-1", 2, "007", "m:1", "say \"x\"\n{\\}\té\u2028", 2.0, "t2"),
        ("r-1", 3, "007", "m:1", None, 4.0, "t3"), ("r-1", 9, "007", "m:1", "beyond", 8.0, "t9"), ("77", 1, None, None, "y = 1", 0.5, None),
    ]
    tests = [("77", 1, "modified", 1, "passed"), ("77", 1, "reference", 1, "passed"), ("77", 1, "rerun", 1, "crash")]
    base = spark.createDataFrame(attempts, ATTEMPTS)
    kept = judging.within_limits(base)
    judged = judging.judge(base, spark.createDataFrame(tests, OUTCOMES), TEMPLATE, ["os"])
    from pyspark.sql import functions as F

    return records.run_records(judged, kept, F.lit("ref"), F.lit("a note"))


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.select(*RUN_RECORD.names).collect()))


def test_a_record_has_every_field(built):
    assert built.schema.simpleString() == RUN_RECORD.simpleString()
    got = {r.run_id: r for r in built.collect()}
    one, two = got["r-1"], got["77"]
    assert [a.iteration for a in one.execution_attempts] == [1, 2, 3]
    assert one.execution_attempts[1].model_output_raw == "say \"x\"\n{\\}\té\u2028" and one.execution_attempts[2].model_output_raw == ""
    assert (one.timestamp, one.scoring.iterations_required, one.scoring.task_success, one.scoring.runtime_seconds) == ("t3", 3, False, 7.0)
    first = one.execution_attempts[0].validation_report
    assert [(s.stage, s.passed, s.details) for s in first.stages] == [("syntax", False, {"line_number": "1"})]
    report = two.execution_attempts[0].validation_report
    assert report.regression_detected and report.regression_details.endswith("Failed to execute pytest") and two.scoring.task_success
    assert two.artifacts.original_template_hash != two.artifacts.modified_template_hash == report.modified_template_hash
    assert two.notes == "a note" and two.task_id is None


def test_round_trip_of_every_field(spark, built, tmp_path):
    path = str(tmp_path)
    records.commit_runs(built, path, "b")
    assert rows(records.read_runs(spark, path)) == rows(built)
    assert [r.run_id for r in records.read_runs(spark, path, 77).collect()] == ["77"]
    reports = {r.run_id: r.validation_report for r in records.read_reports(spark, path).collect()}
    last = {r.run_id: r.execution_attempts[-1].validation_report for r in built.collect()}
    assert reports == last
    assert records.rejected_runs(spark, path).count() == 0


def test_a_commit_that_runs_again_replaces_itself(spark, built, tmp_path):
    path = str(tmp_path)
    records.commit_runs(built, path, "b")
    records.commit_runs(built.filter("run_id = '77'"), path, "b")
    records.commit_runs(built.filter("run_id = 'r-1'"), path, "c")
    assert sorted((r.commit, r.run_id) for r in records.read_runs(spark, path).collect()) == [("b", "77"), ("c", "r-1")]


def test_an_aborted_commit_is_not_read(spark, built, tmp_path):
    path = str(tmp_path)
    assert records.read_runs(spark, path).count() == 0 and records.read_runs(spark, f"{path}/absent").count() == 0
    records.commit_runs(built, path, "b")
    records.commit_runs(built, path, "c")
    os.remove(f"{path}/commit=c/_SUCCESS")
    assert {r.commit for r in records.read_runs(spark, path).collect()} == {"b"}
    assert {r.commit for r in records.read_reports(spark, path).select("commit").collect()} == {"b"}


def test_broken_lines_are_rejects_and_older_records_stay_readable(spark, built, tmp_path):
    path = str(tmp_path)
    records.commit_runs(built, path, "b")
    lines = ['{"run_id": "cut', '{"run_id": "old", "task_id": "t", "unheard_of": {"a": [1]}}', '{"task_id": "t"}', '{"run_id": "odd", "execution_attempts": 7}', "[]"]
    folder = f"{path}/commit=a/kind=result/task_id=t/model_name=m"
    os.makedirs(folder)
    with open(f"{folder}/x.txt", "w") as f:
        f.write("\n".join(lines))
    open(f"{path}/commit=a/_SUCCESS", "w").close()
    assert {r.run_id for r in records.read_runs(spark, path).collect()} == {"r-1", "77", "old"}
    assert sorted(r.line for r in records.rejected_runs(spark, path).collect()) == sorted([lines[0], *lines[2:]])
    assert {r.line: r.reason for r in records.rejected_runs(spark, path).collect()}[lines[2]] == "no run_id"
