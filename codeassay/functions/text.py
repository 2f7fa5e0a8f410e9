"""Native text expressions with Python's whitespace and newline semantics."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from codeassay.schemas import WHITESPACE

# Body of a Java character class matching the same characters as WHITESPACE.
WS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
WS_NO_NEWLINE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE if c != "\n")


def text_of(col: Column | str) -> Column:
    """Null output counts as empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column) -> Column:
    """``str.strip()``: one linear native pass, no regex."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def has(col: Column, *needles: str) -> Column:
    """True when any literal occurs. Literal search only, so no wildcards to escape."""
    return reduce(or_, (F.contains(col, F.lit(n)) for n in needles))


def matches(col: Column, pattern: str) -> Column:
    """Regex search in which ``\\s`` means Python whitespace."""
    return col.rlike(pattern.replace(r"\s", f"[{WS}]"))


def read_back(col: Column) -> Column:
    """Text as it reads after a round trip through a text file: every line ending is a newline."""
    return F.when(
        F.contains(col, F.lit("\r")),
        F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
    ).otherwise(col)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose values are computed once, whatever is filtered or selected later.

    Catalyst rewrites a later filter over computed columns into their definitions and evaluates it
    below them. For layered text expressions that repeats every regex and grows the generated code
    beyond what compiles; a one-row generator keeps the definitions in one place.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
