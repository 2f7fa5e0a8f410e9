import hashlib
import re
from collections import Counter, defaultdict

import llm_cases
import pytest

from codeassay.llm import exact_dedup as xd

LAST = 2**63 - 1


def brute(rows):
    """Per row: doc_id, keep_id, group_size, text_sha256; and kept rows per (keep_id, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[ \t\n\x0b\x0c\r]+", " ", r[1] or "")].append(r[0])
    out, kept = Counter(), Counter()
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: LAST if i is None else i)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, keep, len(ids), digest) for i in ids)
        kept[keep, digest] += 1
    return out, kept


def found(df):
    rows = df.collect()
    return (
        Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows),
        Counter((r.doc_id, r.text_sha256) for r in rows if r.kept),
    )


@pytest.mark.parametrize("bits", [1, 4])
def test_odd_rows(spark, bits):
    assert found(xd.dedup(llm_cases.table(spark), bits)) == brute(llm_cases.rows())


def test_no_rows(spark):
    assert xd.dedup(llm_cases.empty(spark)).count() == 0


def test_a_group_of_a_third_of_all_rows_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(xd, "RUN_BITS", 3)
    rows = [(1000 - i, "the same  text" if i % 3 else f"text {i // 2}", None, None, None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").repartition(37)
    assert found(xd.dedup(df, 2)) == brute(rows)


def test_an_entry_meets_at_most_one_entry_of_each_neighbour(spark, monkeypatch):
    monkeypatch.setattr(xd, "RUN_BITS", 2)
    df = spark.range(0, 400, 1, 20).selectExpr("id AS doc_id", "'x' AS text")
    levels = xd.merge_levels(xd.digest_rows(df), 2)
    assert [x.count() for x in levels] == [100, 20, 5, 2, 1]
    assert levels[-1].first()["n"] == 400


def test_different_white_space_is_one_space_and_other_space_is_text(spark):
    rows = [(3, "a \t\nb"), (2, "a b"), (1, "a b"), (4, " a b"), (5, "a\x1cb")]
    df = xd.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.keep_id for r in df.collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_the_plan_has_no_python_and_merges_in_order(spark):
    plan = xd.dedup(llm_cases.table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = xd.digest_rows(llm_cases.table(spark))
    merged = xd._merged(rows.selectExpr("part", *xd.KEY, "struct(id, row) AS least", "1L AS n"), rows.part)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 and "HashAggregate" not in plan
