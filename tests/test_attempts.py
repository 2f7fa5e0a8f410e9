"""Diffs, stage reports and run reduction against a plain-Python walk through small runs."""

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codeassay.functions.arrow_udfs import diff_stats, syntax_verdict
from codeassay.operators import diffs, runs, validation

TEMPLATE = "def hello():\n    return 'old'\n"
SIG = "def generate_user_report(users):\n    return 1"
ATTEMPTS = "run_id long, iteration int, task_id string, model string, output string, duration_seconds double"


def fence(code):
    return f"```python\n{code}\n```"


@pytest.fixture(scope="module")
def attempt_rows():
    rng = random.Random(2)
    out = []
    for run in range(40):
        for iteration in range(1, rng.randint(1, 6) + 1):
            output = rng.choice(["", None, "   ", fence(SIG), fence("x = 1\ny = 2"), fence("class A:\n    pass"), "a\r\nb\rc", f"raw {run}"])
            out.append((run, iteration, "t", f"m{run % 3}", output, float(iteration)))
    return out


@pytest.fixture(scope="module")
def attempts(spark, attempt_rows):
    return spark.createDataFrame(attempt_rows, ATTEMPTS).repartition(4)


def content_of(output):
    if output is None or not output.strip():
        return None
    return output[10:-4].strip() if output.startswith("```") else output.strip()


def walk(attempt_rows):
    """(run, iteration) -> (file before, new content)."""
    seen, files = {}, {}
    for run, iteration, *_, output, _ in sorted(attempt_rows, key=lambda r: r[:2]):
        before = files.get(run, TEMPLATE)
        new = content_of(output)
        seen[run, iteration] = before, new
        if new is not None:
            files[run] = new.replace("\r\n", "\n").replace("\r", "\n")
    return seen


@pytest.mark.parametrize("block", [1, 2, 64])
def test_carried_content(attempts, attempt_rows, block):
    rows = diffs.carried_content(attempts, TEMPLATE, block).collect()
    got = {(r.run_id, r.iteration): (r.content_before, r.content) for r in rows}
    assert len(rows) == len(got)
    assert got == walk(attempt_rows)


def test_patch_size(attempts, attempt_rows):
    truth = walk(attempt_rows)
    rows = diffs.patch_size(attempts, TEMPLATE).collect()
    assert len(rows) == len(truth)
    for r in rows:
        before, new = truth[r.run_id, r.iteration]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (new is not None, abs(len(new) - len(before)) if new is not None else 0, sha(before), sha(new) if new is not None else "")
        assert (r.patch_applied, r.bytes_changed, r.original_hash, r.modified_hash) == want


def test_missing_target_is_never_patched(spark):
    df = spark.createDataFrame([(1, 1, "t", "m", fence(SIG), 1.0)], ATTEMPTS)
    row = diffs.patch_size(df, F.lit(None).cast("string")).first()
    assert (row.patch_applied, row.patch_error, row.bytes_changed, row.original_hash) == (False, "Target file not found", 0, "")


def library_diff(old, new):
    a, b = old.splitlines(), new.splitlines()
    blocks = difflib.SequenceMatcher(None, a, b).get_opcodes()
    shown = list(difflib.unified_diff(a, b, fromfile="old", tofile="new", lineterm=""))
    return {
        "lines_changed": sum(max(i2 - i1, j2 - j1) for t, i1, i2, j1, j2 in blocks if t != "equal"),
        "lines_added": len([x for x in shown if x.startswith("+") and not x.startswith("+++")]),
        "lines_deleted": len([x for x in shown if x.startswith("-") and not x.startswith("---")]),
        "diff_lines": len(shown),
        "original_line_count": len(a),
        "modified_line_count": len(b),
    }


def test_diff_helper_equals_library():
    rng = random.Random(4)
    words = ["a", "b", "c", "++x", "--y", "", "d\x0be"]
    for _ in range(3000):
        old, new = ("\n".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(2))
        assert diff_stats(old, new) == library_diff(old, new)
    long_old = "\n".join(rng.choices(words, k=600))  # popular lines, beyond the 200-line threshold
    assert diff_stats(long_old, long_old + "\nz") == library_diff(long_old, long_old + "\nz")


def test_diff_measures(attempts, attempt_rows):
    truth = walk(attempt_rows)
    for r in diffs.diff_measures(diffs.carried_content(attempts, TEMPLATE)).collect():
        before, new = truth[r.run_id, r.iteration]
        want = library_diff(before, new) if new is not None else dict.fromkeys(library_diff("", ""), 0)
        for name in ("lines_changed", "lines_added", "lines_deleted", "diff_lines"):
            assert r[name] == want[name]


# --- validation -------------------------------------------------------------


def test_syntax_verdicts(spark):
    cases = {
        "def f():\n    return 1": (True, None, "", []),
        "def f(:": (False, 1, None, []),
        "def f():\nreturn 1": (False, 2, "Line 2: Indentation error", []),
        "if x:\n\ty\n        z": (False, 3, "Line 3: Indentation error", []),
        "import a.b, c as d\nfrom e.f import g\nfrom . import h\nimport c": (True, None, "", ["a", "c", "e", "."]),
        "try:\n    import x\nexcept E:\n    import y\nclass K:\n    import z\ndef f():\n    import w": (True, None, "", ["x", "y", "z"]),
        "x = '\\d'": (True, None, "", []),
        "a\x00b": (False, None, None, []),
        "(" * 5000: (False, None, None, []),
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "i int, content string")
    rows = {r.i: r for r in validation.syntax_audit(df).collect()}
    for i, (code, (ok, line, message, imports)) in enumerate(cases.items()):
        row = rows[i]
        assert (row.syntax_passed, row.import_roots) == (ok, imports), code[:40]
        assert row.error_type == (None if ok else "syntax_error")
        if message is not None:
            assert (row.line_number, row.error_message) == (line, message)
        if ok:
            assert row.lines_of_code == len(code.splitlines())
    assert (rows[99].syntax_passed, rows[99].error_type) == (False, "patch_application_failed")
    assert syntax_verdict("x = (")["error_message"].startswith("Line 1: ")


def test_import_audit(spark):
    df = spark.createDataFrame([(1, "import os, numpy, pandas"), (2, "import os"), (3, "def ("), (4, "x")], "i int, content string")
    rows = {r.i: r for r in validation.import_audit(validation.syntax_audit(df), ["os", "json"]).collect()}
    assert set(rows) == {1, 2, 4}  # the stage runs only after syntax passed
    assert (rows[1].missing_modules, rows[1].error_message, rows[1].error_type) == (
        ["numpy", "pandas"],
        "Missing module: numpy",
        "import_error",
    )
    assert rows[2].imports_passed and rows[4].imports_passed


OUTCOMES = "response_id long, subject string, test_id int, outcome string"


def test_test_verdicts_and_regressions(spark):
    sets = {
        1: ("passed", "passed"),
        2: ("passed", "failed"),
        3: ("passed", "timeout"),
        4: ("failed", "crash"),
        5: ("failed", "failed"),
    }
    rows = [(i, s, t, o) for i, pair in sets.items() for s, last in zip(("reference", "modified"), pair) for t, o in ((1, "passed"), (2, last))]
    rows += [(6, "modified", 1, "failed"), (7, "reference", 1, "passed")]
    outcomes = spark.createDataFrame(rows, OUTCOMES)
    keys = spark.createDataFrame([(i,) for i in range(1, 9)], "response_id long")
    got = {(r.response_id, r.subject): (r.passed, r.error_type) for r in validation.test_verdicts(outcomes, keys).collect()}
    assert [got[i, "modified"] for i in range(1, 9)] == [
        (True, None),
        (False, "verification_failed"),
        (False, "timeout"),
        (False, "runtime_crash"),
        (False, "verification_failed"),
        (False, "verification_failed"),
        (False, "verification_failed"),
        (False, "verification_failed"),
    ]
    regressed = {r.response_id: (r.regression_detected, r.regression_details) for r in validation.regressions(outcomes).collect()}
    assert {i for i, (hit, _) in regressed.items() if hit} == {2, 3, 7}
    assert regressed[3][1].endswith("Modified error: Pytest execution timed out")
    assert regressed[6] == (False, "")  # no reference: skipped


STAGES = "run_id long, iteration int, stage string, stage_ord int, passed boolean, error_type string"


def stage_rows(run, iteration, syntax, imports, tests, error="verification_failed"):
    return [
        (run, iteration, "syntax", 1, syntax, None if syntax else "syntax_error"),
        (run, iteration, "imports", 2, imports, None if imports else "import_error"),
        (run, iteration, "tests", 3, tests, None if tests else error),
    ]


def test_first_failure_reports(spark):
    rows = (
        stage_rows(1, 1, True, True, True)
        + stage_rows(1, 2, False, False, True)
        + stage_rows(1, 3, True, False, True)
        + stage_rows(1, 4, True, True, False, "timeout")
        + stage_rows(1, 5, True, True, True)[:2]
        + stage_rows(1, 6, True, True, False, "unheard_of")
    )
    got = {r.iteration: r for r in validation.validation_reports(spark.createDataFrame(rows, STAGES)).collect()}

    def view(i):
        r = got[i]
        return r.overall_passed, r.verification_passed, [s.stage for s in r.stages], r.error_type

    assert view(1) == (True, True, ["syntax", "imports", "tests"], None)
    assert view(2) == (False, False, ["syntax"], "syntax_error")
    assert view(3) == (False, False, ["syntax", "imports"], "import_error")
    assert view(4) == (False, False, ["syntax", "imports", "tests"], "timeout")
    assert view(5) == (False, False, ["syntax", "imports"], None)
    assert view(6) == (False, False, ["syntax", "imports", "tests"], None)


# --- runs -------------------------------------------------------------------


def test_run_reduction_and_scores(spark):
    outputs = [
        (1, 1, "t", "m", fence("class A:\n    pass"), 1.5),
        (1, 2, "t", "m", fence(SIG), 2.5),
        (1, 3, "t", "m", fence("never run"), 9.0),
        (2, 1, "t", "m", fence("class A:\n    pass"), 1.0),
        (2, 2, "t", "m", "", 1.0),
        (2, 3, "t", "m", None, 1.0),
        (2, 4, "t", "m", fence(SIG), 1.0),
        (3, 1, "t", "n", "", 4.0),
    ]
    stages = (
        stage_rows(1, 1, True, True, False)
        + stage_rows(1, 2, True, True, True)
        + stage_rows(2, 1, False, True, True)
        + stage_rows(2, 2, True, False, True)
        + stage_rows(2, 3, True, True, False, "timeout")
        + stage_rows(2, 4, True, True, True)
    )
    attempts = spark.createDataFrame(outputs, ATTEMPTS)
    reports = validation.validation_reports(spark.createDataFrame(stages, STAGES))
    judged = runs.with_reports(attempts, reports)
    final = {r.run_id: (r.iteration, r.success) for r in runs.final_attempts(judged).collect()}
    assert final == {1: (2, True), 2: (3, False), 3: (1, False)}
    need = {r.run_id: (r.iterations_required, r.task_success) for r in runs.iterations_required(judged).collect()}
    assert need == final
    took = {r.run_id: (r.attempts, r.runtime_seconds) for r in runs.run_duration(judged).collect()}
    assert took == {1: (2, 4.0), 2: (3, 3.0), 3: (1, 4.0)}
    four = {r.run_id: r.iteration for r in runs.final_attempts(judged, 4).collect()}
    assert four[2] == 4

    regressed = spark.createDataFrame([(2, True)], "run_id long, regression_detected boolean")
    lines = diffs.diff_measures(diffs.carried_content(attempts, TEMPLATE)).select("run_id", "iteration", "lines_changed")
    scores = {r.run_id: r for r in runs.run_scores(attempts, reports, regressed, TEMPLATE, line_diffs=lines).collect()}
    one, two, three = scores[1], scores[2], scores[3]
    assert (one.task_success, one.verification_passed, one.compliance_score, one.iterations_required) == (True, True, 10, 2)
    assert (one.bytes_changed, one.lines_changed, one.error_type) == (abs(len(SIG) - len("class A:\n    pass")), 2, None)
    assert (one.tokens_used, one.model_output_length) == (len(fence(SIG)) // 4, len(fence(SIG)))
    # the empty final answer leaves the class of the first attempt to be scored
    assert (two.compliance_score, two.bytes_changed, two.lines_changed, two.error_type, two.regression_detected) == (5, 0, 0, "timeout", True)
    # nothing was ever written: the template itself is scored
    assert (three.compliance_score, three.task_success, three.error_type) == (7, False, None)
    board = {r.model: r for r in runs.leaderboard(spark.createDataFrame(list(scores.values()))).collect()}
    assert (board["m"].runs, board["m"].success_rate, board["m"].mean_compliance) == (2, 0.5, 7.5)


def test_duration_by_timestamps(spark):
    rows = [(1, 1, False, "2024-01-01 00:00:00"), (1, 2, True, "2024-01-01 00:00:07.5"), (1, 3, True, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "run_id long, iteration int, success boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert runs.run_duration(df).first().runtime_seconds == 7.5


def test_prompts(spark):
    task = spark.createDataFrame(
        [("t", "Name", "Aim", ["c1", "c2"], None, "Works", TEMPLATE, "ref = 1\n")],
        "task_id string, name string, objective string, constraints array<string>, rules array<string>, "
        "expected_behavior string, template_text string, reference_text string",
    )
    attempts = spark.createDataFrame([(1, 1, "t", "m", fence("x = 1"), 1.0), (1, 2, "t", "m", "", 1.0)], ATTEMPTS)
    got = {r.iteration: r.prompt for r in runs.prompts(attempts, task).collect()}
    head = "You are an expert Python developer. Your task is to refactor and fix code.\n\nTASK: Name\nOBJECTIVE: Aim\n\nCONSTRAINTS:\n  - c1\n  - c2\n\nRULES:\n\n\nCURRENT CODE:\n```python\n"
    tail = (
        "\n\nOUTPUT INSTRUCTIONS:\n1. Return ONLY the complete, corrected Python code.\n2. Wrap your code in ```python``` markers.\n"
        "3. Do NOT include any explanation or comments outside the code block.\n"
        "4. Ensure the code is syntactically correct and passes all requirements.\n"
    )
    assert got[1] == head + TEMPLATE + "\n```\n\nEXPECTED BEHAVIOR:\nWorks\n\n" + tail
    reference = "REFERENCE SOLUTION (for iteration 2):\n```python\nref = 1\n\n```\n"
    assert got[2] == head + "x = 1\n```\n\nEXPECTED BEHAVIOR:\nWorks\n\n" + reference + tail


def test_recent_runs(spark):
    df = spark.createDataFrame([("a", 3), ("c", 1), ("b", 2)], "run_id string, ts int")
    assert [r.run_id for r in runs.recent_runs(df, 2).collect()] == ["c", "b"]
    assert [r.run_id for r in runs.recent_runs(df, None, by="ts").collect()] == ["a", "b", "c"]
