"""Failure-mode flags and quick-score points over the raw response text (literal search only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeassay.functions.text import has, text_of
from codeassay.schemas import FAILURE_MODES, NO_FAILURE, NO_OUTPUT_ISSUE, SIGNATURE

_ANY_ENTRY = "def generate_user_report("
_SELF_ENTRY = "def generate_user_report(self"


def mode_flags(output: Column) -> dict[str, Column]:
    """Failure mode -> boolean, in reporting order. Null output is treated as empty."""
    text = text_of(output)
    # Cheap outer tests first: a text without "def " or "return " skips the searches inside them.
    defines, returns = has(text, "def "), has(text, "return ")
    entry = defines & has(text, _ANY_ENTRY)
    flags = {
        "signature_parameter_mismatch": entry & ~has(text, SIGNATURE),
        "completely_different_name": defines & ~has(text, _ANY_ENTRY),
        "no_function_definition": ~defines,
        "class_introduction": has(text, "class "),
        "self_parameter_oop": defines & has(text, _SELF_ENTRY),
        "file_io_hallucination": has(text, "open(", ".txt", ".csv"),
        "external_dependency_datetime": has(text, "datetime")
        & has(text, "import datetime", "from datetime"),
        "suspicious_external_imports": has(text, "import ") & ~has(text, "collections", "operator"),
        "returns_dict_not_string": returns & has(text, "return {", "return dict"),
        "returns_non_string_iterable": returns & has(text, "return [", "return ("),
        "no_deduplication": ~has(text, "seen", "set()"),
        "no_sorting": ~has(text, "sort"),
        # "active" is part of "inactive", so one search decides both
        "no_active_inactive_separation": ~has(text, "inactive"),
    }
    return {mode: flags[mode] for mode in FAILURE_MODES}


def modes_array(flags: dict[str, Column]) -> Column:
    """Detected modes in reporting order, or the sentinel alone."""
    found = F.array_compact(F.array(*[F.when(flag, F.lit(mode)) for mode, flag in flags.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_FAILURE))).otherwise(found)


def quick_facts(output: Column) -> dict[str, Column]:
    """The literal facts behind the quick score, each named once."""
    text = text_of(output)
    defines, returns = has(text, "def "), has(text, "return ")
    signed, self_entry = defines & has(text, SIGNATURE), defines & has(text, _SELF_ENTRY)
    return {
        "empty": text == "",
        "signed": signed,
        "self_entry": self_entry,
        "classy": has(text, "class "),
        "self_refs": self_entry & has(text, "self."),
        "dedups": has(text, "seen", "set()"),
        "sorts": has(text, "sort"),
        "separates": has(text, "inactive"),
        "guards": has(text, "isinstance", "None", "type("),
        "returns_text": returns & has(text, 'return "', "return '") | has(text, ".join("),
    }


def quick_score(facts: dict[str, Column]) -> Column:
    def points(fact: str, yes: int, no: int = 0) -> Column:
        return F.when(facts[fact], F.lit(yes)).otherwise(F.lit(no))

    entry = F.when(facts["self_entry"], F.lit(-3)).otherwise(points("signed", 1, -2))
    total = (
        entry
        + points("classy", -2)
        + points("self_refs", -2)
        + points("dedups", 2)
        + points("sorts", 2)
        + points("separates", 2)
        + points("guards", 1)
        + points("returns_text", 1)
    )
    clamped = F.greatest(F.lit(0), F.least(F.lit(10), total))
    return F.when(facts["empty"], F.lit(0)).otherwise(clamped).cast("int")


def quick_is_compliant(facts: dict[str, Column]) -> Column:
    return ~facts["empty"] & facts["signed"] & ~facts["self_entry"] & ~facts["classy"]


def quick_issues(facts: dict[str, Column]) -> Column:
    """Ordered issue texts (fixed values)."""
    wordings = [
        (
            facts["self_entry"],
            "CRITICAL: Function has 'self' parameter (introduced class method)",
        ),
        (
            ~facts["self_entry"] & ~facts["signed"],
            "WARNING: Function signature does not match required 'generate_user_report(users)'",
        ),
        (
            facts["classy"],
            "CRITICAL: Code introduces unnecessary class definition (violates standalone requirement)",
        ),
        (
            facts["self_refs"],
            "CRITICAL: Function converted to instance method with 'self' references",
        ),
        (~facts["dedups"], "Missing deduplication logic"),
        (~facts["sorts"], "Missing sorting logic for active users"),
        (~facts["separates"], "Missing active/inactive user separation"),
        (
            ~facts["returns_text"],
            "May not return string format (check return statements)",
        ),
    ]
    listed = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in wordings]))
    return F.when(facts["empty"], F.array(F.lit(NO_OUTPUT_ISSUE))).otherwise(listed)
