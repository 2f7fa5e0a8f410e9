from collections import Counter
from itertools import permutations

import llm_cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeassay.llm import filter_audit as fa

LAST = 2**63 - 1


def fails(rows):
    """The letters each row fails, told anew from the definition."""
    owner: dict = {}
    for r in rows:
        owner[r[1] or ""] = min(owner.get(r[1] or "", LAST), LAST if r[0] is None else r[0])
    for r in rows:
        text = r[1] or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        yield "".join(
            f
            for f, bad in [
                ("A", len(words) < 100),
                ("B", len(set(words)) < 0.8 * len(words)),
                ("C", 10 * sum("A" <= c <= "Z" for c in text) > len(text)),
                ("D", any(c in "#$%&*|" for c in text)),
                ("E", owner[text] < (LAST if r[0] is None else r[0])),
            ]
            if bad
        )


def brute(rows, labels):
    """Filters applied one after the other to the documents themselves."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = [(r[2] or "", r[0], f) for r, f in zip(rows, fails(rows), strict=True)]
    out = Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        found, total = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                total[f] += len(gone)
                lost = [sum(d[1] is not None and d[1] in ids for d in gone) for ids in (good, toxic)]
                failing, alone = sum(f in d[2] for d in mine), sum(f == d[2] for d in mine)
                found.append(((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost), f))
        out.update((*row, total[f]) for row, f in found)
    return out


def label_table(spark, labels):
    return spark.createDataFrame([(*x, 1, "x") for x in labels], "doc_id long, quality int, toxic int, mask int, digest string")


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_odd_rows(spark):
    rows = llm_cases.rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 230, 2)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, 1), (77777, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    assert found(fa.audit(llm_cases.table(spark), label_table(spark, labels))) == brute(rows, labels)


def test_no_rows(spark):
    assert fa.audit(llm_cases.empty(spark), label_table(spark, [(1, 1, 1)])).count() == 0
    no_labels = fa.audit(llm_cases.table(spark), label_table(spark, [])).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(no_labels) == (0, 0)


def test_a_text_of_a_third_of_all_rows_in_every_part(spark):
    rows = [(900 - i, "HOT text #" if i % 3 else f"some text {i // 4} " * (i % 90), ["en", "de", None, ""][i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(900)]
    assert found(fa.audit(df, label_table(spark, labels))) == brute(rows, labels)


def test_the_smallest_id_of_a_text_may_be_in_another_part(spark):
    rows = [(2, "same", "en"), (1, "same", "de"), (1, "same", "de"), (None, "same", "fr"), (None, "same", "fr")]
    counted = fa.cells(fa.failing(spark.createDataFrame(rows, "doc_id long, text string, lang string")), label_table(spark, []))
    assert {(r.part, r.mask): r.n for r in counted.collect()} == {("en", 17): 1, ("de", 1): 2, ("fr", 17): 2}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.data())
def test_every_state_of_the_walk_counts_what_no_active_filter_fails(k, data):
    masks = data.draw(st.lists(st.integers(0, 2**k - 1), unique=True))
    n = np.array([[data.draw(st.integers(0, 9)), 1] for _ in masks], np.int64).reshape(len(masks), 2)
    states = fa.gray_walk(masks, n, k)
    for s in range(2**k):
        want = sum((row for m, row in zip(masks, n, strict=True) if m & s == 0), np.zeros(2, np.int64))
        assert states[s].tolist() == want.tolist()


@pytest.mark.parametrize("text,letters", [
    ("w " * 99, "AB"), (" ".join(f"w{i}" for i in range(100)), ""), (" ".join(f"w{i % 80}" for i in range(100)), ""),
    (" ".join(f"w{i % 79}" for i in range(100)), "B"), ("Aééééééééé", "A"), ("AAééééééééé", "AC"), ("", "A"), ("|", "AD"),
])
def test_limits(text, letters):
    assert fa.failures(text.encode()) == sum(1 << "ABCDE".index(x) for x in letters)
