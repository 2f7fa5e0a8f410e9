import re
from collections import Counter

import llm_cases
import pytest

from codeassay.llm import host_rules as hr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
    )


def test_measures_of_odd_rows(spark):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in hr.host_rules(llm_cases.table(spark)).collect()
    )
    want = Counter()
    for r in llm_cases.rows():
        b = base(r[1])
        want[(r[0], *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want
    assert hr.host_rules(llm_cases.empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a b c d e " * 3, "a a a a a a a", "a b c d e f a b c d e g a b c d e", "x", ""])
def test_words_in_repeated_windows(text):
    m = hr.measure(text.encode())
    assert (m[0], m[1], m[2], m[3], m[4]) == base(text)


SYMBOLS = "".join(f" %%{k}%%" for k in range(8))


def hosts(bad, good, n):
    text = " ".join(f"plain{i}" for i in range(30))
    return [(i, text + (SYMBOLS if i < bad else ""), "en", "h", 1) for i in range(n)] + [
        (1000 + i, text + (SYMBOLS if i < good else ""), "en", "g", 1) for i in range(n)
    ]


def test_a_rare_failure_in_a_good_host_is_forgiven(spark):
    rows = hosts(bad=60, good=1, n=400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    kept = {r.doc_id for r in hr.keep_good(df).collect()}
    assert kept == set(range(60, 400)) | set(range(1000, 1400))
    again = {r.doc_id for r in hr.host_rules(df).filter("kept").collect()}
    assert again == kept


def test_small_hosts_are_shrunk_to_the_others(spark):
    rows = hosts(bad=100, good=100, n=400) + [(9000, rows_text(), "en", "tiny", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    rate = {(r.host, r.rule): r.shrunk for r in hr.host_verdicts(hr.text_stats(df)).collect()}
    assert 0.2 < rate["tiny", "symbols"] <= 0.26 and abs(rate["h", "symbols"] - 0.25) < 0.01


def rows_text():
    return " ".join(f"plain{i}" for i in range(30))


def test_rows_keep_all_columns(spark):
    df = llm_cases.table(spark)
    kept = hr.keep_good(df)
    assert kept.schema == df.schema
    want = hr.host_rules(df).filter("kept").groupBy("doc_id").count().collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id: r["count"] for r in want})


def test_each_text_is_measured_once(spark, tmp_path):
    """The rows that come back are read from what was measured."""
    df = llm_cases.table(spark)
    kept = hr.keep_good(df)
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.schema == df.schema and hr.keep_good(llm_cases.empty(spark)).count() == 0
    judged = Counter(r.doc_id for r in hr.host_rules(df).filter("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == judged
