import math
import tracemalloc
import zlib
from collections import Counter

import llm_cases
import numpy as np
import pyarrow as pa
import pytest

from codeassay.llm import maxent as me

SMALL = me.Shape(single=4, hashed=4, rows=64, steps=6)


def brute_base(texts, training):
    tokens = [me.tokens_of(t and t.encode()) for t in texts]
    counts = Counter(t for text in training for t in me.tokens_of(text and text.encode()))
    n, v = sum(counts.values()), len(counts)
    return n, [
        (len(ts), sum(t in counts for t in ts), sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for ts in tokens
    ]


@pytest.mark.parametrize("head", [3, 40, 1 << 18])
def test_base_scores_of_odd_rows(spark, monkeypatch, head):
    monkeypatch.setattr(me, "HEAD", head)
    rows = llm_cases.rows()
    docs = llm_cases.table(spark)
    training = docs.filter("doc_id < 150")
    n, want = brute_base([r[1] for r in rows], [r[1] for r in rows if r[0] is not None and r[0] < 150])
    found = me.score_texts(docs, training, SMALL).collect()
    assert {r.train_tokens for r in found} == {n} and len(found) == len(rows)
    key = lambda i, w: (repr(i), w[0], w[1], round(w[2], 6))
    got = sorted(key(r.doc_id, (r.n_tokens, r.n_known, r.base_score)) for r in found)
    assert got == sorted(key(r[0], w) for r, w in zip(rows, want, strict=True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_the_head_does_not_change_scores(spark, monkeypatch):
    docs = llm_cases.table(spark)
    scores = []
    for head in (40, 1 << 18):
        monkeypatch.setattr(me, "HEAD", head)
        found = me.score_texts(docs, docs, me.Shape(single=1, hashed=4, rows=64, steps=4)).collect()
        scores.append(sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6)) for r in found))
    assert scores[0] == scores[1]


def test_probabilities_add_up(spark):
    """Over all known words and one unseen word for each hashed class, after any history."""
    texts = ["a b c a b d a b c", "b c a a d e f g", "x y z a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocabulary = sorted({w for t in texts for w in t.split()})
    unseen: dict = {}
    k = 0
    while len(unseen) < SMALL.hashed:
        word = f"new{k}"
        unseen.setdefault(SMALL.hashed_class(word.encode()), word)
        k += 1
    tries = ["a b " + w for w in (*vocabulary, *unseen.values())] + ["a b", "a"]
    found = {r.doc_id: r.score for r in me.score_texts(spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string"), df, SMALL).collect()}
    # P(text) = P(a) P(b|a) P(w|a b) P(end|b w): only the ends differ in history, so divide by them.
    learned = me.train(me.context_counts(df, _vocabulary(df), SMALL), SMALL)
    logs = me.class_table(learned, SMALL)
    v = _vocabulary(df)()
    cls = lambda w: v.cls[v.number[w]] if w in v.number else SMALL.hashed_class(w)
    total, size = 0.0, SMALL.classes
    first = found[len(tries) - 2] - logs[cls(b"a") * size + cls(b"b"), 0]
    for i, w in enumerate((*vocabulary, *unseen.values())):
        end = logs[cls(b"b") * size + cls(w.encode()), 0]
        total += 10 ** (found[i] - first - end)
    total += 10 ** (logs[cls(b"a") * size + cls(b"b"), 0])
    assert abs(total - 1) < 1e-6


def _vocabulary(df):
    found = me._vocabulary(me.stable(me.word_counts(df)), SMALL)
    return lambda: found


def test_training_lowers_the_loss(spark):
    texts = ["a b c d " * 30, "c d a b " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = me.score_texts(df, df, me.Shape(single=8, hashed=2, rows=64)).collect()
    assert all(r.score > 0.4 * r.base_score for r in found)


def test_nothing_to_learn_from(spark):
    docs = llm_cases.table(spark)
    found = me.score_texts(docs, docs.limit(0), SMALL).collect()
    assert {r.n_known for r in found} == {0} and all(math.isfinite(r.score) for r in found)
    assert all(abs(r.base_score - r.n_tokens * math.log10(0.5 / 0.5)) < 1e-9 for r in found)
    assert me.score_texts(llm_cases.empty(spark), docs, SMALL).count() == 0


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = me.op6_maxent_score(spark, "/root/testdata/sf0.1").collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    out = [r for r in rows if r.held_out]
    assert np.sum([r.score for r in out]) > np.sum([r.base_score for r in out])


def test_the_model_grows_with_the_corpus():
    few, many = me.Shape.grown(10**6), me.Shape.grown(10**9)
    assert many.classes > 5 * few.classes and many.rows > 2 * few.rows and me.Shape.grown(0).classes >= 64


def test_words_before_count_within_a_class(spark):
    """Two words of one class after two words of one class: only features of the words themselves tell."""
    shape = me.Shape(single=1, hashed=1, rows=64, steps=4)
    texts = ["red apple", "blue plum"] * 20 + ["red x apple", "blue x plum"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tries = ["red apple", "blue apple", "red x plum", "blue x plum"]
    found = me.score_texts(spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string"), df, shape)
    score = [r.score for r in found.orderBy("doc_id").collect()]
    assert score[0] > score[1] + 0.3 and score[3] > score[2] + 0.3


def brute_log_words(leaf, words, n, weights, shape):
    """The tree's fit with features in dictionaries, event by event."""
    nodes, sides, odds = me._tree(weights)
    z = {}
    for level in range(len(nodes)):
        live = [e for e in range(len(leaf)) if nodes[level][leaf[e]] >= 0]
        z.update({(level, e): odds[nodes[level][leaf[e]]] for e in live})
        fitted = [{} for _ in words]
        for _ in range(shape.rounds):
            for family, w in zip(words, fitted, strict=True):
                sums: dict = {}
                for e in (e for e in live if e < len(n)):
                    p = 1 / (1 + math.exp(-z[level, e]))
                    s = sums.setdefault((nodes[level][leaf[e]], family[e]), [0, 0])
                    s[0] += n[e] * (sides[level][leaf[e]] - p)
                    s[1] += n[e] * p * (1 - p)
                change = {k: max(-2, min(2, (a - shape.ridge * w.get(k, 0)) / (b + shape.ridge))) for k, (a, b) in sums.items()}
                for k, x in change.items():
                    w[k] = w.get(k, 0) + x
                for e in live:
                    z[level, e] += change.get((nodes[level][leaf[e]], family[e]), 0)
    return [
        -sum(math.log1p(math.exp(-x if sides[l][leaf[e]] else x)) for (l, e2), x in z.items() if e2 == e) for e in range(len(leaf))
    ]


def test_words_within_a_class_against_brute_force():
    rng = np.random.default_rng(5)
    leaf = rng.integers(0, 6, 60).astype(np.int32)
    words = rng.integers(0, 2**32, (3, 4), dtype=np.uint64).astype(np.uint32)
    words = np.stack([w[rng.integers(0, 4, 60)] for w in words])
    n, weights = rng.integers(1, 4, 40).astype(float), np.append(np.bincount(leaf[:40], minlength=5)[:5] + 0.5, 0.5)
    leaf[:40] = np.minimum(leaf[:40], 4)
    got = me._log_words(leaf, words, n, weights, SMALL)
    assert np.allclose(got, brute_log_words(leaf, words, n, weights, SMALL), atol=1e-6)


def test_gain_over_the_base_on_held_out_texts(spark):
    out = [r for r in me.op6_maxent_score(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score - r.base_score for r in out) > 0.4 * sum(r.n_tokens for r in out)


ODD = ["", "  ", None, "a", " A\x0b\x0cB \x1c\x1d c\xa0d\u2028E \x85", "\t\nAb\r\rC\u00c4 ", "x  y", "\x00 \U0001f600 b"]


def test_numbers_are_those_of_the_tokens(spark):
    """Without a head all words are the batch's others; with one they have its numbers, and ends are numbered too."""
    for learned in ([], ["b a zz c\xa0d\u2028e", "a"]):
        df = spark.createDataFrame(list(enumerate(learned)), "doc_id long, text string")
        v = me._vocabulary(me.word_counts(df), SMALL)
        numbers, starts, cls, others = me._Numbers(v).of([t and t.encode() for t in ODD])
        names = {k: w for w, k in v.number.items()}
        if not learned:
            names[0] = me.END
        names.update(enumerate(others, len(names)))
        want = [me.tokens_of(t and t.encode()) for t in ODD]
        assert [names[k] for k in numbers.tolist()] == [w for tokens in want for w in tokens]
        assert starts.tolist() == [sum(map(len, want[:i])) for i in range(len(want))]
        assert all(cls[k] == SMALL.hashed_class(w) for k, w in names.items() if w in others)


def test_numbering_takes_few_bytes_a_token(spark):
    """No token is an object of its own: on 0.51 GB that took an executor over its memory."""
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(30_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 30_000, 1000)).encode() for _ in range(300)]
    df = spark.createDataFrame([(0, " ".join(words[:20_000]))], "doc_id long, text string")
    v = me._vocabulary(me.word_counts(df), SMALL)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        found = me._Numbers(v).of(texts)
        taken = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(found[0]) == 300 * 1001 and taken < 50 * len(found[0])


def brute_cells(texts, v, shape):
    cells, number = Counter(), v.number
    for t in texts:
        cls = [0, 0, *(int(v.cls[number[w]]) for w in me.tokens_of(t and t.encode()))]
        cells.update((a * shape.classes + b, c) for a, b, c in zip(cls, cls[1:], cls[2:], strict=False))
    return cells


def test_cells_and_gradient_steps_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(me, "CELLS", 100)
    monkeypatch.setattr(me, "HELD", 500)
    monkeypatch.setattr(me, "SLICE", 7)
    shape = me.Shape(single=3, hashed=4, rows=40, steps=5)
    texts = [r[1] for r in llm_cases.rows()]
    df = llm_cases.table(spark).select("text")
    v = me._vocabulary(me.stable(me.word_counts(df)), shape)
    want = brute_cells(texts, v, shape)
    contexts = me.context_counts(df, lambda: v, shape)
    got = {}
    for r in contexts.collect():
        n, context, each = np.frombuffer(r.contexts, np.int64).reshape(3, -1)
        count, c = np.frombuffer(r.cells, np.int64, each.sum()), np.frombuffer(r.cells, np.int32, offset=8 * each.sum())
        assert r.n == n.sum() == count.sum()
        got.update(zip(zip(np.repeat(context, each).tolist(), c.tolist(), strict=True), count.tolist(), strict=True))
    assert got == want
    weights, mean, square = (np.zeros((shape.rows, shape.classes)) for _ in range(3))
    context, c = np.array(list(want)).T
    n, rows = np.array(list(want.values()), float), me.features(context, shape)
    for step in range(1, shape.steps + 1):
        error = np.exp(me.log_softmax(weights, rows)) * n[:, None]
        error[np.arange(len(c)), c] -= n
        g = np.zeros_like(weights)
        for row in rows.T:
            np.add.at(g, row, error)
        g = g / n.sum() + shape.decay * weights
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        scaled = (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-9)
        weights = weights - shape.rate * (1 - (step - 1) / shape.steps) * scaled
    found = me.train(contexts, shape)
    every = np.unique(context)
    logs = [me.log_softmax(w, me.features(every, shape)) for w in (weights, found)]
    assert np.abs(logs[0] - logs[1]).max() < 1e-3


def test_a_step_moves_only_the_rows_of_its_contexts():
    out = np.zeros((600, 4))
    out[[3, 300, 599]] = 1
    sent = [(x["k"][0], np.frombuffer(x["at"][0], np.int32).tolist(), len(x["g"][0])) for x in me._slices(out, np.float32)]
    assert sent == [(0, [3], 16), (1, [300 - me.SLICE], 16), (2, [599 - 2 * me.SLICE], 16)]


def test_features_of_words_share_no_cell():
    """Many words before, each seen once before either of two words: each tells for itself."""
    leaf = np.tile(np.array([0, 1], np.int32), 4000)
    before = np.arange(8000, dtype=np.uint32) * np.uint32(2654435761)
    none = np.zeros(8000, np.uint32)
    got = me._log_words(leaf, np.stack([before, none, none]), np.ones(8000), np.array([4000.5, 4000.5, 0.5]), SMALL)
    assert len(set(np.round(got, 9))) == 2
