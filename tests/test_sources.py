"""Task specs, task catalog, results and fingerprints, over files in a temporary folder."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeassay.operators import batch, runs, validation
from codeassay.schemas import RESPONSES
from codeassay.sources import registry, results, tasks
from test_attempts import ATTEMPTS, STAGES, stage_rows

FULL = {
    "task_id": "full",
    "name": "N",
    "category": "c",
    "difficulty": "d",
    "workflow": "w",
    "extra_key": {"kept": [1, 2]},
    "execution_config": {"max_iterations": 5, "validation_order": ["syntax"], "test_command": "run"},
    "model_instructions": {"objective": "o", "constraints": ["a", "b"], "rules": ["r"]},
    "evaluation": {"scoring_rules": {"deduplication": {"points": 4, "check_for": "set"}}, "max_score": 20},
}


@pytest.fixture(scope="module")
def tasks_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("tasks")

    def make(name, spec, files=("template.py", "reference.py", "tests/test_task.py")):
        folder = root / name
        folder.mkdir()
        if spec is not None:
            (folder / "spec.json").write_text(spec if isinstance(spec, str) else json.dumps(spec, indent=1))
        for file in files:
            (folder / file).parent.mkdir(exist_ok=True)
            (folder / file).write_text("x = 1\n")

    make("full", FULL)
    make("moved", FULL)
    make("bare", {k: FULL[k] for k in ("task_id", "name", "category", "difficulty", "workflow")} | {"task_id": "bare"})
    make("no_workflow", {k: v for k, v in FULL.items() if k != "workflow"})
    make("broken", '{"task_id": ')
    make("array", "[1]")
    make("typed", FULL | {"name": 3, "execution_config": {"max_iterations": "x", "timeout_seconds": 2.5}})
    make("optional", FULL | {"language": 5, "notes": None, "verification": [], "evaluation": {"scoring_rules": "x", "max_score": "7"}})
    make("order", FULL | {"execution_config": {"validation_order": [], "max_iterations": 3.0, "timeout_seconds": True}})
    make("gaps", FULL, files=("template.py",))
    make("no_spec", None)
    return str(root)


def test_specs(spark, tasks_dir):
    got = {r.folder: r for r in tasks.read_task_specs(spark, tasks_dir).collect()}
    assert len(got) == 10
    full = got["full"]
    assert (full.status, full.problems, full.id_mismatch) == ("valid", [], False)
    assert (full.max_iterations, full.timeout_seconds, full.test_command, full.max_score) == (5, 60, "run", 20)
    assert (full.language, full.entry_file, full.method) == ("python", "template.py", "rule_based_compliance")
    assert (full.objective, full.constraints, full.rules, full.validation_order) == ("o", ["a", "b"], ["r"], ["syntax"])
    assert full.scoring_rules["deduplication"].points == 4
    assert json.loads(full.spec.toJson())["extra_key"] == {"kept": [1, 2]}
    assert (got["moved"].status, got["moved"].id_mismatch) == ("valid", True)  # a warning only
    bare = got["bare"]
    assert (bare.status, bare.max_iterations, bare.scoring_rules) == ("valid", 3, None)
    assert bare.validation_order == ["syntax", "imports", "tests"]
    assert (got["no_workflow"].status, got["no_workflow"].problems) == ("reject", ["missing:workflow"])
    assert got["broken"].problems == ["invalid_json"] and got["array"].problems == ["not_an_object"]
    assert got["typed"].problems == [
        "invalid:name",
        "invalid:execution_config.max_iterations",
        "invalid:execution_config.timeout_seconds",
    ]


def test_optional_fields_have_types(spark, tasks_dir):
    got = {r.folder: r for r in tasks.read_task_specs(spark, tasks_dir).collect()}
    assert got["optional"].problems == ["invalid:language", "invalid:notes", "invalid:evaluation.scoring_rules", "invalid:verification"]
    order = got["order"]
    assert (order.status, order.validation_order, order.max_iterations, order.timeout_seconds) == ("valid", [], 3, 1)


def test_load_one(spark, tasks_dir):
    assert tasks.load_task(spark, tasks_dir, "full").count() == 1
    assert tasks.load_task(spark, tasks_dir, "broken").count() == 0
    assert tasks.load_task(spark, tasks_dir, "unheard_of").count() == 0


def test_catalog_and_structure(spark, tasks_dir):
    files = tasks.list_task_files(spark, tasks_dir)
    names = [r.task for r in tasks.available_tasks(files).collect()]
    assert names == sorted(["full", "moved", "bare", "no_workflow", "broken", "array", "typed", "optional", "order", "gaps"])
    gaps = {r.task: (r.missing_files, r.is_valid) for r in tasks.structure_gaps(files).collect()}
    assert gaps["full"] == ([], True)
    assert gaps["gaps"] == (["reference.py", "tests"], False)
    assert gaps["no_spec"] == (["spec.json"], False)


def test_registry(spark):
    rows = registry.registered_models(spark).orderBy("ordinal").collect()
    assert [r.name for r in rows] == ["qwen2.5-coder", "llama3", "mistral"]


def test_run_results_round_trip(spark, tmp_path):
    attempts = spark.createDataFrame([(r, i, "t", f"m{r}", "x", 1.0) for r in (1, 2) for i in (1, 2)], ATTEMPTS)
    stages = [s for r in (1, 2) for i in (1, 2) for s in stage_rows(r, i, True, r == 2, i == 2)]
    judged = runs.with_reports(attempts, validation.validation_reports(spark.createDataFrame(stages, STAGES)))
    nested = results.assemble_runs(runs.executed(judged))
    path = str(tmp_path / "out")
    results.write_run_results(nested, path)
    back = results.read_run_results(spark, path)
    assert back.select(*nested.columns).exceptAll(nested).isEmpty() and back.count() == 2
    assert results.read_run_results(spark, path, 1).count() == 1
    assert results.read_run_results(spark, path, 77).count() == 0
    long = {(r.run_id, r.iteration, r.stage): (r.stage_ord, r.passed) for r in results.explode_attempts(back).collect()}
    assert long == {
        **{("1", i, s): (o, s == "syntax") for i in (1, 2) for o, s in ((1, "syntax"), (2, "imports"))},
        **{("2", i, s): (o, s != "tests" or i == 2) for i in (1, 2) for o, s in ((1, "syntax"), (2, "imports"), (3, "tests"))},
    }
    last = spark.read.parquet(f"{path}/reports").filter("run_id = 2").first().last_attempt
    assert (last.iteration, last.success, len(last.stages)) == (2, True, 3)


def test_batch_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "llama3", 1, "sort", 2.0, None), (2, "t", "llama3", 2, None, None, "HTTP 500")], RESPONSES)
    path = str(tmp_path / "batch")
    results.write_batch_results(df, path, "b7")
    rows = results.read_batch_runs(spark, path, "b7").collect()
    assert [(r.batch_id, r.response_id, r.score) for r in rows] == [("b7", 1, 0)]
    summary = spark.read.json(f"{path}/batch_id=b7/summary").first()
    assert (summary.total_runs, summary.batch_id) == (1, "b7")


def test_a_batch_is_scored_once_and_its_summary_comes_last(spark, tmp_path):
    rows = [(i, "t", "llama3", i, ["sort", "class A", None, "def f(): return [1]"][i % 4], 2.0, "HTTP 500" if i % 7 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, RESPONSES).repartition(5)
    path = str(tmp_path)
    for _ in range(2):  # again: the batch is replaced
        results.write_batch_results(df, path, "b")
    want = batch.batch_summary(df)
    got = results.read_batch_summary(spark, path, "b", want.select(F.lit("b").alias("batch_id"), "*").schema)
    assert got.drop("batch_id").first().asDict() == want.first().asDict()
    assert results.read_batch_runs(spark, path, "b").count() == 51
    broken = df.withColumn("output", F.when(F.col("response_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="lost"):
        results.write_batch_results(broken, path, "b")
    assert not os.path.exists(f"{path}/batch_id=b/summary")


def test_no_rows_have_a_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "llama3", 1, "x", 2.0, "HTTP 500")], RESPONSES)
    results.write_batch_results(df, str(tmp_path), "b")
    row = spark.read.json(f"{tmp_path}/batch_id=b/summary").first()
    assert (row.total_runs, row.compliant_rate, row.mean_score) == (0, 0.0, 0.0)


def test_fingerprints(spark, tasks_dir):
    df = spark.createDataFrame([("é",), ("",), (None,)], "t string")
    got = [r.h for r in df.select(results.fingerprint("t").alias("h")).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in ("é", "", "")]
    files = results.file_fingerprints(spark, f"{tasks_dir}/full").collect()
    assert len(files) == 4
    assert hashlib.sha256(b"x = 1\n").hexdigest() in {r.sha256 for r in files}


@pytest.mark.parametrize("whole", [0, 100, results.WHOLE_BYTES])
def test_files_in_pieces_have_the_hash_of_the_whole(spark, tmp_path, whole):
    r = random.Random(3)
    texts = {f"d{k % 3}/f{k}": r.randbytes(k * k * 7) for k in range(1, 12)} | {"a b%20[1]#é": b"odd", "big": r.randbytes(results.CHUNK * 2 + 5)}
    for name, text in texts.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r.path.split(f"{tmp_path}/")[1]: r.sha256 for r in results.file_fingerprints(spark, str(tmp_path), whole).collect()}
    assert got == {name: hashlib.sha256(text).hexdigest() for name, text in texts.items()}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """No array of bytes could hold it; most of it is a hole, so it takes no disk."""
    with open(tmp_path / "huge", "wb") as f:
        f.write(b"head")
        f.truncate((1 << 31) + 12345)
    want = hashlib.sha256(b"head")
    for _ in range((1 << 31) // (1 << 26)):
        want.update(bytes(1 << 26))
    want.update(bytes(12345 - 4))
    assert [r.sha256 for r in results.file_fingerprints(spark, str(tmp_path)).collect()] == [want.hexdigest()]
