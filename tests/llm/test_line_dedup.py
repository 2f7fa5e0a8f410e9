from collections import Counter

import llm_cases
import pytest

from codeassay.llm import line_dedup as ld

LAST = 2**63 - 1


def brute(rows):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    owner: dict = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            i = LAST if r[0] is None else r[0]
            owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for r in rows:
        i = LAST if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in df.collect())


def test_odd_rows(spark):
    assert found(ld.dedup_lines(llm_cases.table(spark))) == brute(llm_cases.rows())
    assert ld.dedup_lines(llm_cases.empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [1, 40])
def test_a_line_that_fills_many_ranges(spark, parts):
    hot = "A very common line"
    rows = [(i, "\n".join([f"only {i} here!", hot if i % 3 else hot.lower(), f"shared by two {i // 2}", hot]), "e", "s", 1) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
        assert found(ld.dedup_lines(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps_hold_no_text(spark):
    rows = [(1, "the same line\nmine", "e", "s", 1), (2, "yours\nthe same line", "e", "s", 1)]
    maps = ld.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")).collect()
    assert [(m.id, m.n_lines) for m in maps] == [(2, 2)] and len(maps[0].keep) < 16
