"""Failure modes and quick scores: literal expectations for each mode, both ways."""

import random

import pytest

from codeassay.operators import scoring
from codeassay.schemas import FAILURE_MODES, NO_FAILURE

CLEAN = "def generate_user_report(users):\n seen sort active inactive"


def expected_modes(t):
    t = t or ""
    out = []
    if "def generate_user_report(users)" not in t:
        if "def generate_user_report(" in t:
            out.append("signature_parameter_mismatch")
        else:
            out.append("completely_different_name" if "def " in t else "no_function_definition")
    tests = [
        ("class_introduction", "class " in t),
        ("self_parameter_oop", "def generate_user_report(self" in t),
        ("file_io_hallucination", any(x in t for x in ("open(", ".txt", ".csv"))),
        ("external_dependency_datetime", "import datetime" in t or "from datetime" in t),
        ("suspicious_external_imports", "import " in t and "collections" not in t and "operator" not in t),
        ("returns_dict_not_string", "return {" in t or "return dict" in t),
        ("returns_non_string_iterable", "return [" in t or "return (" in t),
        ("no_deduplication", "seen" not in t and "set()" not in t),
        ("no_sorting", "sort" not in t),
        ("no_active_inactive_separation", "inactive" not in t),
    ]
    return (out + [m for m, hit in tests if hit]) or [NO_FAILURE]


SINGLE = [
    ("signature_parameter_mismatch", CLEAN.replace("(users)", "(rows)")),
    ("completely_different_name", CLEAN.replace("generate_user_report", "other")),
    ("no_function_definition", CLEAN.replace("def ", "")),
    ("class_introduction", CLEAN + " class X"),
    ("self_parameter_oop", CLEAN + " def generate_user_report(self"),
    ("file_io_hallucination", CLEAN + " open("),
    ("file_io_hallucination", CLEAN + " a.txt"),
    ("file_io_hallucination", CLEAN + " a.csv"),
    ("external_dependency_datetime", CLEAN + " from datetime"),
    ("suspicious_external_imports", CLEAN + " import os"),
    ("returns_dict_not_string", CLEAN + " return {"),
    ("returns_dict_not_string", CLEAN + " return dict"),
    ("returns_non_string_iterable", CLEAN + " return ["),
    ("returns_non_string_iterable", CLEAN + " return ("),
    ("no_deduplication", CLEAN.replace("seen", "")),
    ("no_sorting", CLEAN.replace("sort", "")),
    ("no_active_inactive_separation", CLEAN.replace("inactive", "")),
    (NO_FAILURE, CLEAN),
    (NO_FAILURE, CLEAN.replace("seen", "set()")),
]
BITS = ["def ", "generate_user_report(", "users)", "self", "class ", "open(", ".txt", "import ", "from ", "datetime", "collections",
        "operator", "return ", "{", "dict", "[", "(", "seen", "set()", "sort", "active", "in", "isinstance", "None", "type(", '"', "'",
        ".join(", "self.", "def generate_user_report(users)"]


def sample():
    rng = random.Random(7)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(4000)] + [None, ""]


def test_modes(spark):
    texts = [t for _, t in SINGLE] + sample()
    rows = scoring.failure_modes(spark.createDataFrame(list(enumerate(texts)), "i int, output string")).collect()
    for row in rows:
        assert row.failure_modes == expected_modes(texts[row.i]), texts[row.i]
        if row.i < len(SINGLE):
            assert row.failure_modes == [SINGLE[row.i][0]]
    assert {m for m, _ in SINGLE} == {*FAILURE_MODES, NO_FAILURE}


def expected_quick(t):
    if not t:
        return 0, False, ["No output generated"]
    signed, selfed = "def generate_user_report(users)" in t, "def generate_user_report(self" in t
    score, issues = 0, []

    def note(ok, gain, issue, loss=0):
        if not ok and issue:
            issues.append(issue)
        return gain if ok else loss

    if selfed:
        score, _ = -3, issues.append("CRITICAL: Function has 'self' parameter (introduced class method)")
    else:
        score = note(signed, 1, "WARNING: Function signature does not match required 'generate_user_report(users)'", -2)
    score += note("class " not in t, 0, "CRITICAL: Code introduces unnecessary class definition (violates standalone requirement)", -2)
    score += note(not (selfed and "self." in t), 0, "CRITICAL: Function converted to instance method with 'self' references", -2)
    score += note("seen" in t or "set()" in t, 2, "Missing deduplication logic")
    score += note("sort" in t, 2, "Missing sorting logic for active users")
    score += note("inactive" in t, 2, "Missing active/inactive user separation")
    score += note("isinstance" in t or "None" in t or "type(" in t, 1, None)
    score += note('return "' in t or "return '" in t or ".join(" in t, 1, "May not return string format (check return statements)")
    return max(0, min(10, score)), signed and not selfed and "class " not in t, issues


def test_quick_scores(spark):
    texts = [t for _, t in SINGLE] + sample() + [CLEAN + ' isinstance return "']
    rows = scoring.quick_scores(spark.createDataFrame(list(enumerate(texts)), "i int, output string")).collect()
    for row in rows:
        got = (row.score, row.is_compliant, row.compliance_issues)
        assert got == expected_quick(texts[row.i]), texts[row.i]
        assert row.normalized == pytest.approx(row.score / 10)
    assert max(r.score for r in rows) == 9  # the points sum to nine
