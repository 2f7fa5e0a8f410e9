"""Compliance features over extracted code.

Each regex sits behind a literal ``contains`` test of a substring it cannot match without, so
the common negative case stays a native byte search and never builds a Java string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeassay.functions.text import WS_NO_NEWLINE, has, matches
from codeassay.schemas import ENTRY_FUNCTION, SIGNATURE

# A class statement at a line start. Only whitespace may precede the keyword, so a comment sign
# cannot, and the whole search is one pass over the text instead of one per line.
_CLASS_STATEMENT = rf"(?:\A|\n)[{WS_NO_NEWLINE}]*class[{WS_NO_NEWLINE}]+[\p{{L}}\p{{N}}_]"


def introduces_class(code: Column) -> Column:
    return has(code, "class") & code.rlike(_CLASS_STATEMENT)


def takes_self(code: Column) -> Column:
    return has(code, ENTRY_FUNCTION) & matches(code, rf"def\s+{ENTRY_FUNCTION}\s*\(\s*self")


def feature_columns(code: Column, signature: Column | str = SIGNATURE) -> dict[str, Column]:
    """Rule name -> boolean. For the three penalty rules, true means the code is compliant."""
    wanted = F.lit(signature) if isinstance(signature, str) else signature
    return {
        "signature_compliance": F.contains(code, wanted),
        "no_class_introduction": ~introduces_class(code),
        "no_self_parameter": ~takes_self(code),
        "deduplication": (has(code, "set") & matches(code, r"set\s*\("))
        | (has(code, "seen") & matches(code, r"in\s+seen")),
        "sorting_active_users": has(code, "sort") & matches(code, r"\.sort\s*\(|sorted\s*\("),
        "correct_counts": has(code, "inactive")
        & matches(code, r"len\s*\(\s*active")
        & matches(code, r"len\s*\(\s*inactive"),
        "robust_input_handling": has(code, "isinstance") & matches(code, r"isinstance\s*\("),
        "string_return_format": (has(code, ".join") & matches(code, r"\.join\s*\("))
        | (has(code, "return") & matches(code, r"return\s+f['\"]")),
    }
