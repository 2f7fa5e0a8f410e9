import random
import re
import zlib
from collections import Counter

import llm_cases
import numpy as np
import pytest

from codeassay.llm import spelling as sp


def near(a, b):
    """Whether one code point is inserted, deleted or replaced, told by the common ends of the words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows, least=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode("utf-8"))
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    form, out = {}, {}
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), None if form[w] is None else n[form[w]])
    return out


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def misspelt(r, words, n):
    """Texts of words, some with one edit."""
    letters = "abcdefgé÷ÿ"
    for i in range(n):
        out = []
        for w in r.choices(words, weights=[1 + 300 // (k + 1) for k in range(len(words))], k=r.randrange(40)):
            for _ in range(r.random() < 0.5 and r.randrange(3)):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + r.choice(letters) + w[k:]])
            out.append(r.choice([w, w, w, w.upper(), w.title()]))
        yield i, r.choice([" ", ", ", "1", "Ÿ", "-"]).join(out)


@pytest.mark.parametrize("round_bytes", [sp.ROUND_BYTES, 1024])
def test_random_vocabularies(spark, round_bytes):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 9))) for _ in range(60)]
    rows = [*misspelt(r, words, 600), (None, "aaaaaab " * 7), (5, None), (6, "")]
    want = brute(rows)
    assert sum(x[3] > 0 for x in want.values()) > 50 and any(x[0] for x in want.values())
    assert found(sp.variants(table(spark, rows), round_bytes=round_bytes)) == want


def test_odd_rows(spark):
    rows = [(x[0], x[1]) for x in llm_cases.rows()]
    assert found(sp.variants(llm_cases.table(spark), least_count=1)) == brute(rows, least=1)
    assert sp.variants(llm_cases.empty(spark)).count() == 0


def test_long_words_share_a_shard(spark):
    w = "abcdefghij" * 30
    words = [w[:63], w[:64], w[:65], w[:66], "x" + w[1:65], w, w[:150] + w[151:], w[:9] + "z" + w[10:], w[::-1], w + w]
    rows = [(k, " ".join([x] * (5 + 30 * (i % 3)))) for i, x in enumerate(words) for k in range(2)]
    want = brute(rows)
    assert want[w[:64]][3] >= 2
    assert found(sp.variants(table(spark, rows))) == want


def test_ties_go_to_the_first_in_code_points(spark):
    rows = [(1, "abcdef " * 6 + "abcdeé " * 40 + "abcdez " * 40 + "xbcdef " * 40 + "abcdff " * 30)]
    assert found(sp.variants(table(spark, rows)))["abcdef"][:2] == ("abcdez", "abcdez")


def test_a_chain_of_forms_ends_in_its_last_word(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    rows = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(chain)]
    got = found(sp.variants(table(spark, rows)))
    assert got == brute(rows) and got[chain[0]][1] == chain[-1]


def test_hashes_of_edits_are_those_of_the_edited_words():
    words = ["aabbéÿ", "zz", "abcabcabc", "x" * 70]
    of = {w: sp.Letters.of([w]).whole()[0] for w in words}
    assert sp.Letters.of(words).whole().tolist() == [of[w] for w in words]
    at, h = sp.Letters.of(words).deleted()
    want = [sp.Letters.of([e]).whole()[0] for w in words for e in dict.fromkeys(w[:k] + w[k + 1 :] for k in range(len(w)))]
    assert sorted(h.tolist()) == sorted(want)
    assert len(at) == len(want)


def test_rounds_are_bounded_and_cover_every_block():
    n_blocks = {6: 100, 7: 1000, 8: 64, 9: 64, 64: 64}
    rounds = list(sp._rounds(n_blocks, 8 * 130))
    assert all(sum(high - low for _, low, high in part) <= 130 for part in rounds)
    covered = Counter((s, b) for part in rounds for s, low, high in part for b in range(low, high))
    assert covered == Counter((s, b) for s, n in n_blocks.items() for b in range(n))


def test_filters_let_few_strangers_through():
    r = random.Random(1)
    words = list({"".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(40_000)})
    h = sp.Letters.of(words).whole()
    n_blocks = len(words) * sp.BITS_PER_WORD // 64
    blocks = np.zeros(n_blocks, np.uint64)
    np.bitwise_or.at(blocks, sp.block_of(h, n_blocks), sp._bits(h))
    shard = sp.Shard(n_blocks, 0, blocks)
    assert len(shard.has(h)) == len(h)
    others = ["".join(r.choice("klmnopqrst") for _ in range(8)) for _ in range(40_000)]
    assert len(shard.has(sp.Letters.of(others).whole())) < 400
