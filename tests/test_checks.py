"""Compliance features and scores, literal cases and a plain-Python statement of the patterns."""

import random
import re

import pytest

from codeassay.operators import scoring
from codeassay.schemas import DEFAULT_RULES

SIG = "def generate_user_report(users)"


def expected(code):
    def found(pattern):
        return re.search(pattern, code) is not None

    classy = any(re.search(r"^\s*class\s+\w+", line.split("#")[0]) for line in code.split("\n"))
    return {
        "signature_compliance": SIG in code,
        "no_class_introduction": not classy,
        "no_self_parameter": not found(r"def\s+generate_user_report\s*\(\s*self"),
        "deduplication": found(r"set\s*\(") or found(r"in\s+seen"),
        "sorting_active_users": found(r"\.sort\s*\(") or found(r"sorted\s*\("),
        "correct_counts": found(r"len\s*\(\s*active") and found(r"len\s*\(\s*inactive"),
        "robust_input_handling": found(r"isinstance\s*\("),
        "string_return_format": found(r"\.join\s*\(") or found(r"return\s+f'") or found(r'return\s+f"'),
    }


CASES = [
    (SIG + ":", {"signature_compliance": True}),
    ("def generate_user_report(users, context):", {"signature_compliance": False}),
    ("\nclass UserReport:\n    pass\n", {"no_class_introduction": False}),
    (SIG + ":\n    pass\n", {"no_class_introduction": True}),
    ("# class Foo\nx  # class Bar", {"no_class_introduction": True}),
    ("subclass X", {"no_class_introduction": True}),
    ("\u00a0class\u2003Δ:", {"no_class_introduction": False}),
    ("\rclass X:", {"no_class_introduction": False}),
    ("def generate_user_report(self, users):", {"no_self_parameter": False}),
    ("def  generate_user_report (\n self)", {"no_self_parameter": False}),
    ("seen = set()", {"deduplication": True}),
    ("seen = []", {"deduplication": False}),
    ("if a in  seen", {"deduplication": True}),
    ("active.sort(key=k)", {"sorting_active_users": True}),
    ("active = []", {"sorting_active_users": False}),
    ("len(active) len( inactive", {"correct_counts": True}),
    ("len(active)", {"correct_counts": False}),
    ("if isinstance (users, list):", {"robust_input_handling": True}),
    ("return users", {"robust_input_handling": False}),
    ('return "\\n".join(lines)', {"string_return_format": True}),
    ('return f"Report: {data}"', {"string_return_format": True}),
    ("return  f'x'", {"string_return_format": True}),
    ("return data", {"string_return_format": False}),
]


def test_features(spark):
    rng = random.Random(11)
    bits = ["def", "class", " ", "\n", "generate_user_report", "(", "self", "users", ")", "set", "in", "seen", ".sort", "sorted",
            "len", "active", "inactive", "isinstance", ".join", "return", "f'", 'f"', "#", "\t", "X", "\x1c", "\u00a0", SIG]
    texts = [c for c, _ in CASES] + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(4000)]
    rows = scoring.features(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).collect()
    for row in rows:
        got = {rule: row[rule] for rule in DEFAULT_RULES}
        # a lone carriage return reads back from a file as a newline
        assert got == expected(re.sub("\r\n?", "\n", texts[row.i])), repr(texts[row.i])
        if row.i < len(CASES):
            assert CASES[row.i][1].items() <= got.items(), texts[row.i]


def test_score_clamps_and_weights(spark):
    worst = "class A:\n    def generate_user_report(self): pass"
    full = SIG + "\nset( .sort( len(active len(inactive isinstance( .join("
    df = spark.createDataFrame([(1, worst), (2, full), (3, None), (4, "x")], "i int, content string")
    got = {r.i: (r.raw_score, r.compliance_score) for r in scoring.compliance_score(df).collect()}
    assert got == {1: (2, 2), 2: (18, 10), 3: (0, 0), 4: (7, 7)}


RULES = "task_id string, scoring_rules map<string,struct<description:string,penalty_if_violated:int,points:int,check_for:string>>"


@pytest.fixture
def specs(spark):
    own = {
        "signature_compliance": (None, -9, None, "def f()"),
        "deduplication": (None, None, 7, None),
        "no_class_introduction": (None, None, None, None),
    }
    return spark.createDataFrame([("none", None), ("empty", {}), ("own", own)], RULES)


def test_effective_rules(specs):
    rows = {(r.task_id, r.rule): (r.weight, r.check_for) for r in scoring.effective_rules(specs).collect()}
    assert len(rows) == 24
    for task in ("none", "empty"):
        for rule, (_, weight, check_for) in DEFAULT_RULES.items():
            assert rows[task, rule] == (weight, check_for)
    assert rows["own", "signature_compliance"] == (-9, "def f()")
    assert rows["own", "deduplication"][0] == 7
    assert rows["own", "no_class_introduction"][0] == -2
    assert rows["own", "sorting_active_users"][0] == 2


def test_scores_by_task_rules(spark, specs):
    df = spark.createDataFrame(
        [("own", "def f(): set("), ("own", "x"), ("none", "x"), ("unknown", "x")], "task_id string, content string"
    )
    rules = scoring.rule_weights(specs)
    got = [(r.task_id, r.raw_score) for r in scoring.compliance_score(df, rules=rules).collect()]
    assert sorted(got) == [("none", 7), ("own", 1), ("own", 17), ("unknown", 7)]


def test_threshold(spark):
    df = spark.createDataFrame([(1, SIG), (2, "x"), (3, SIG + "\nclass A:")], "i int, content string")
    assert [r.i for r in scoring.passes_threshold(scoring.compliance_score(df)).collect()] == [1]


def test_tokens(spark):
    df = spark.createDataFrame([("abc", "défgh"), ("", "abc"), (None, None)], "p string, r string")
    got = [r.t for r in df.select(scoring.token_estimate(df.p, df.r).alias("t")).collect()]
    assert got == [2, 0, 0]
