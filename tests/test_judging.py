"""Judged attempts against a plain walk through each run."""

import ast
import hashlib
import random
import sys

import pytest

from codeassay.operators import judging, runs
from codeassay.plans import corpus

TEMPLATE = "def hello():\n    return 'old'\n"
ATTEMPTS = "run_id long, iteration int, task_id string, model string, output string, duration_seconds double, timestamp string"
OUTCOMES = "run_id long, iteration int, subject string, test_id int, outcome string"
SIG = "def generate_user_report(users):\n    return 1"
CODES = [SIG, "x = (", "import nowhere\nx = 1", "import os\nx = 1", "if x:\ny = 2", "class A:\n    pass", "import os, elsewhere, nowhere"]
MESSAGES = {
    "crash": ("runtime_crash", "Failed to execute pytest"),
    "timeout": ("timeout", "Pytest execution timed out"),
    "failed": ("verification_failed", "One or more pytest tests failed"),
    None: ("verification_failed", "Test directory not found"),
    "passed": (None, ""),
}


def fence(code):
    return f"```python\n{code}\n```"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    attempts, outcomes = [], []
    for run in range(120):
        for i in range(1, r.randint(1, 7) + 1):
            output = r.choice(["", None, " \n", *[fence(c) for c in CODES], "raw = 1"])
            attempts.append((run, i, f"t{run % 4}", f"m{run % 3}", output, float(i), f"2024-01-01T00:00:{i:02d}"))
            for subject in ("modified", "reference", "rerun"):
                if r.random() < 0.85:
                    worst = r.choice(["passed", "passed", "passed", "failed", "timeout", "crash"])
                    outcomes += [(run, i, subject, t, o) for t, o in enumerate([worst, "passed", "failed" if worst == "crash" else "passed"])]
    outcomes += [(9999, 1, "modified", 1, "passed"), (0, 99, "modified", 1, "passed")]  # of no attempt
    return attempts, outcomes


def fold(outcomes):
    return next((o for o in ("crash", "timeout", "failed", "passed") if o in outcomes), None)


def walk(attempts, outcomes, limit_of):
    """(run, iteration) -> what judging says of it, from the loop told in plain words."""
    found = {}
    for run in {a[0] for a in attempts}:
        current, written, spent, last = TEMPLATE, None, 0.0, None
        for a in sorted((a for a in attempts if a[0] == run), key=lambda a: a[1]):
            i, output = a[1], a[4]
            if i > limit_of(a[2]):
                break
            content = None if output is None or not output.strip() else output[10:-4].strip() if output.startswith("```") else output.strip()
            before, spent = current, spent + a[5]
            current = content if content is not None else current
            stages, error, message = [], None, ""
            try:
                tree = ast.parse(current)
            except SyntaxError as e:
                tree, what = None, "Indentation error" if isinstance(e, IndentationError) else e.msg
                error, message = "syntax_error", f"Line {e.lineno}: {what}"
            stages.append("syntax")
            if tree is not None:
                stages.append("imports")
                names = [n.name for s in tree.body if isinstance(s, ast.Import) for n in s.names if n.name not in sys.stdlib_module_names]
                if names:
                    error, message = "import_error", f"Missing module: {names[0]}"
            verdict = {s: fold([o[4] for o in outcomes if o[:3] == (run, i, s)]) for s in ("modified", "reference", "rerun")}
            if tree is not None and error is None:
                stages.append("tests")
                error, message = MESSAGES[verdict["modified"]]
            success = error is None
            again = verdict["rerun"] or verdict["modified"]
            regressed = success and verdict["reference"] == "passed" and again != "passed"
            details = f"Reference solution passes tests but modified solution fails. Modified error: {MESSAGES[again][1]}" if regressed else ""
            size = 0 if content is None else abs(len(content) - len(before))
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            last = (run, i)
            found[last] = [success, stages, error, message, regressed, details, size, sha(before), sha(current), spent, False]
            if success:
                break
        if last:
            found[last][-1] = True
    return found


def view(r):
    return [
        r.success, [s.stage for s in r.stages], r.error_type, r.error_message, r.regression_detected, r.regression_details, r.bytes_changed,
        r.original_hash, r.modified_hash, r.runtime_seconds, r.is_final,
    ]


@pytest.mark.parametrize("limited", [False, True])
def test_runs_are_judged_as_the_loop_would(spark, rows, limited):
    attempts, outcomes = rows
    tasks = None
    if limited:
        names = "task_id string, task_name string, task_limit int, signature string, " + ", ".join(f"w_{r} int" for r in judging.DEFAULT_RULES)
        tasks = spark.createDataFrame([(f"t{k}", f"T{k}", limit, None, *[None] * 8) for k, limit in ((0, 1), (1, 5), (2, 100))], names)
    got = judging.judge(
        spark.createDataFrame(attempts, ATTEMPTS).repartition(5), spark.createDataFrame(outcomes, OUTCOMES).repartition(3), TEMPLATE, sys.stdlib_module_names, tasks
    ).collect()
    want = walk(attempts, outcomes, (lambda t: {"t0": 1, "t1": 5, "t2": 100, "t3": 3}[t]) if limited else lambda t: 3)
    assert len(got) == len(want)
    assert {(r.run_id, r.iteration): view(r) for r in got} == want
    assert sum(w[4] for w in want.values()) > 3  # regressions happen


def test_scores_are_those_of_the_final_attempt(spark):
    attempts = [
        (1, 1, "t", "m", fence("class A:\n    pass"), 1.0, "a"), (1, 2, "t", "m", fence(SIG), 2.0, "b"), (1, 3, "t", "m", fence("x"), 4.0, "c"),
        (2, 1, "t", "m", fence("class A:\n    pass"), 1.0, "a"), (2, 2, "t", "m", "", 1.0, "b"), (3, 1, "t", "n", None, 4.0, "a"),
    ]
    outcomes = [(1, 2, "modified", 1, "passed"), (2, 1, "modified", 1, "failed"), (2, 2, "modified", 1, "timeout")]
    judged = judging.judge(spark.createDataFrame(attempts, ATTEMPTS), spark.createDataFrame(outcomes, OUTCOMES), TEMPLATE, ["os"])
    lines = spark.createDataFrame([(1, 2, 7), (1, 3, 9)], "run_id long, iteration int, lines_changed int")
    got = {r.run_id: r for r in judging.run_scores(judged, lines).collect()}
    assert (got[1].task_success, got[1].compliance_score, got[1].iterations_required, got[1].lines_changed) == (True, 10, 2, 7)
    # the empty final answer leaves the class of the first attempt to be scored and tested
    assert (got[2].task_success, got[2].compliance_score, got[2].error_type, got[2].lines_changed) == (False, 5, "timeout", 0)
    assert (got[3].compliance_score, got[3].error_type, got[3].tokens_used) == (7, "verification_failed", 0)
    board = {r.model: r.runs for r in runs.leaderboard(judging.run_scores(judged)).collect()}
    assert board == {"m": 2, "n": 1}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_attempts_and_reports_share_one_exchange_and_no_text_moves(spark, rows):
    attempts, outcomes = rows
    df = judging.judge(spark.createDataFrame(attempts, ATTEMPTS), spark.createDataFrame(outcomes, OUTCOMES), TEMPLATE, ["os"])
    exchanges = [line for line in _plan(df).splitlines() if "Exchange hashpartitioning" in line]
    by_run = [x for x in exchanges if "(run_id" in x and "iteration" not in x.split("hashpartitioning(")[1].split(")")[0]]
    assert len(by_run) == 1 and len(exchanges) == 2  # the other one folds test outcomes
    assert _plan(df).count("ArrowEvalPython") <= 2  # the answer's JSON form and one parse for both audits


def test_no_rows(spark):
    df = judging.judge(spark.createDataFrame([], ATTEMPTS), spark.createDataFrame([], OUTCOMES), corpus.TEMPLATE, ["os"])
    assert df.count() == 0 and judging.run_scores(df).count() == 0
