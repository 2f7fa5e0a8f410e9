"""Document tables that every operator must take."""

from __future__ import annotations

import random

#: Extra columns with names that operators use for their own.
CLASHING = "id long, digest long, host string, stats string, overlap string, score double, part int, tokens long, epochs int, key string, doc long, set_id long, _id long, row long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
_EXTRA = (1, 2, "h", "s", "o", 0.5, 3, 4, 5, "k", 6, 7, 8, 9)


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows and ids, ties, and plain prose."""
    r = random.Random(seed)
    common = prose(r, 30)
    found = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\r\n\x0b\x0c ", "en", "a", 7), (4, "one", "en", "a", 3),
        (5, "One", "en", "b", 3), (None, common, "en", "a", 9), (None, None, None, None, None), (6, prose(r, 20_000), "en", "a", 1),
        (7, "\n".join([common] * 3 + ["x"]), "de", "a", 2), (8, common, "de", "b", 2), (8, common, "de", "b", 2), (8, "another text", "de", "b", 2),
        (9, "café ÀÉ 😀 ß\x00 x  y", "fr", "c", 5), (10, "### " * 40, "en", "spam", 1), (11, "\n" * 50, "en", "a", 50),
    ]
    found += [(100 + i, prose(r, r.randrange(1, 60)), r.choice(["en", "de"]), r.choice("abc"), 1) for i in range(40)]
    found += [(200 + i, common + " " + prose(r, i % 5), "en", "a", 1) for i in range(20)]
    return found


def table(spark, seed: int = 1):
    return spark.createDataFrame([(*x, *_EXTRA) for x in rows(seed)], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
