import random
import re
from collections import Counter

import llm_cases
import pytest

from codeassay.llm import decontaminate as dc

ITEMS = "item_id long, text string, note string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, it in items:
        it = words(it)
        k = min(len(it), 10)
        windows = {tuple(it[i : i + k]) for i in range(len(it) - k + 1)} if it else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def random_items(r, letters, n):
    return [(i, " ".join(r.choice(letters) for _ in range(r.randrange(0, 26)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_matches_are_those_of_brute_force(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij"
    items = random_items(r, letters, 12)
    a = dc.Automaton.of([(str(i), dc.words_of(t.encode())) for i, t in items])
    for _ in range(60):
        text = " ".join(r.choice([r.choice(letters), "zz", r.choice(items)[1]]) for _ in range(r.randrange(30)))
        m = a.match(dc.words_of(text.encode()))
        assert (m.n_words, int(m.hit.sum()), sorted(a.ids[i] for i in m.items)) == brute(text, items)


@pytest.mark.parametrize("window", [3, 5])
def test_small_windows_between_unknown_words(window):
    r = random.Random(window)
    words = [f"w{k}" for k in range(40)]
    items = [(str(i), [r.choice(words).encode() for _ in range(12)]) for i in range(6)]
    a = dc.Automaton.of(items, window)
    windows = {tuple(w[i : i + window]): i for _, w in items for i in range(len(w) - window + 1)}
    for _ in range(60):
        text = []
        while len(text) < 60:
            item, at = r.choice(items)[1], r.randrange(12)
            text += [*item[at : at + r.randrange(1, 10)], b"unknown"]
        hit = {i + j for i in range(len(text)) if tuple(text[i : i + window]) in windows for j in range(window)}
        want = sorted(k for k, w in items if any(tuple(w[i : i + window]) == tuple(text[j : j + window]) for i in range(13 - window) for j in range(len(text))))
        m = a.match(text)
        assert (set(m.hit.nonzero()[0].tolist()), sorted(a.ids[i] for i in m.items)) == (hit, want)
        assert hit


@pytest.mark.parametrize("shard_bytes", [1 << 24, 300])
def test_odd_rows_and_several_automata(spark, shard_bytes):
    r = random.Random(9)
    common = llm_cases.rows()[5][1]
    items = [
        (1, common), (2, "one"), (3, None), (4, ""), (None, common[40:]), (6, "ONE!"), (1, common), (7, llm_cases.prose(r, 60)), (8, "?!"),
    ]
    benchmark = spark.createDataFrame([(*x, "n") for x in items], ITEMS)
    found = dc.find_overlaps(llm_cases.table(spark), benchmark, shard_bytes=shard_bytes)
    got = Counter(
        (r.doc_id, r.overlap.n_words, sum(r.overlap.spans[1::2]) - sum(r.overlap.spans[::2]), tuple(r.overlap["items"])) for r in found.collect()
    )
    want = Counter()
    for row in llm_cases.rows():
        n, hit, ids = brute(row[1], items)
        want[row[0], n, hit, tuple(ids)] += 1
    assert got == want
    assert dc.find_overlaps(llm_cases.empty(spark), benchmark).count() == 0
    none = dc.find_overlaps(llm_cases.table(spark), benchmark.limit(0))
    assert none.filter("size(overlap.spans) > 0").count() == 0


@pytest.mark.parametrize("window", [4, 10])
def test_automata_are_bounded_by_words(spark, monkeypatch, window):
    """Items over the bound are cut with all their windows; no automaton has more than two states a word."""
    monkeypatch.setattr(dc, "SHARD_WORDS", 40)
    r = random.Random(2)
    long = [llm_cases.prose(r, 300) for _ in range(3)]
    items = [(i, x) for i, x in enumerate(long)] + [(10 + i, llm_cases.prose(r, 8)) for i in range(20)]
    benchmark = spark.createDataFrame([(*x, "n") for x in items], ITEMS)
    states = [row.n_states for row in dc._automata(benchmark, window, dc.SHARD_BYTES).collect()]
    assert len(states) > 20 and max(states) <= 2 * 40 + 1
    at = [w.split() for w in long]
    docs = [(k, "x " + " ".join(at[k % 3][5 * k : 5 * k + 30]) + " y " + items[3 + k % 20][1]) for k in range(50)] + [(99, None)]
    found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, window).collect()
    one = dc.Automaton.of([(str(i), dc.words_of(x.encode())) for i, x in items], window)
    assert len(found) == 51
    for row in found:
        m = one.match(dc.words_of((row.text or "").encode()))
        hit = {w for a, b in zip(row.overlap.spans[::2], row.overlap.spans[1::2]) for w in range(a, b)}
        assert (row.overlap.n_words, hit) == (m.n_words, set(m.hit.nonzero()[0].tolist()))
        assert row.overlap["items"] == sorted({one.ids[i] for i in m.items})


def test_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = "Nothing here,  to see.\n\tReally! " * 5
    rows = [
        (1, clean, "en", "a", 5), (2, f"{clean}\nAlpha, beta gamma DELTA epsilon zeta eta theta iota kappa lambda!! {clean}", "en", "a", 1),
        (3, item, "en", "a", 1), (4, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    benchmark = spark.createDataFrame([(1, item, "n")], ITEMS)
    cut = dc.decontaminate(df, benchmark)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.schema == df.schema and got.keys() == {1, 2, 4}
    assert got[1].text == clean and got[1].n_chars == 5 and got[4].text is None
    assert "lambda" not in got[2].text.lower() and got[2].text.count("Really!") == 10 and got[2].n_chars == len(got[2].text)
    assert dc.find_overlaps(cut, benchmark).filter("size(overlap.spans) > 0").count() == 0
    assert dc.decontaminate(llm_cases.table(spark), benchmark).schema == llm_cases.table(spark).schema


def test_each_text_meets_the_automaton_once(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    cut = dc.decontaminate(llm_cases.table(spark), spark.createDataFrame([(1, item, "n")], ITEMS))
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_cuts_with_several_automata_are_those_of_one(spark, monkeypatch):
    common = llm_cases.rows()[5][1]
    items = [(1, common), (2, " ".join(common.split()[3:25])), (3, llm_cases.rows()[20][1])]
    benchmark = spark.createDataFrame([(*x, "n") for x in items], ITEMS)
    df = llm_cases.table(spark)
    one = Counter((r.doc_id, r.text) for r in dc.decontaminate(df, benchmark).collect())
    monkeypatch.setattr(dc, "SHARD_WORDS", 20)
    assert Counter((r.doc_id, r.text) for r in dc.decontaminate(df, benchmark).collect()) == one
