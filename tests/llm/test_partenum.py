import random

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeassay.llm import partenum as pe
from codeassay.llm.components import components

LAST = 2**63 - 1


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Sorted (id, n_shingles, component) with every pair compared; rows with one id are one node if they have words."""
    sets = [(LAST if r[0] is None else r[0], shingle_set(r[1])) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i) if s else i) for i, s in sets)


def found(df):
    return sorted((r.id, r.n_shingles, r.component) for r in pe.jaccard_components(df).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def family(r, base, n, most):
    """Copies of a text with more and more words replaced, in clusters and chains."""
    words = base.split()
    out = []
    for _ in range(n):
        copy = list(r.choice(out) if out and r.random() < 0.5 else words)
        for _ in range(r.randrange(most + 1)):
            copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
        out.append(copy)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("seed", range(4))
def test_components_of_families(spark, monkeypatch, seed):
    if seed % 2:  # nearly every group is large, and rounds are short
        monkeypatch.setattr(pe, "SMALL", 3)
    r = random.Random(seed)
    texts = []
    for size in (3, 8, 40, 120):
        base = llm_cases.prose(r, size)
        texts += family(r, base, 18, max(1, size // 12))
        texts += [base + " " + llm_cases.prose(r, k) for k in range(5)]
    shared = llm_cases.prose(r, 40)  # a passage in many otherwise different texts
    texts += [llm_cases.prose(r, r.randrange(60)) + " " + shared + " " + llm_cases.prose(r, r.randrange(30)) for _ in range(40)]
    texts += [llm_cases.prose(r, n) for n in range(30)] + texts[::9]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(frame(spark, rows).repartition(6)) == brute(rows)


def test_groups_over_many_ranges(spark):
    r = random.Random(5)
    base = llm_cases.prose(r, 50)
    rows = list(enumerate(family(r, base, 150, 1)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(frame(spark, rows).repartition(4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [r[:2] for r in llm_cases.rows()]
    assert found(llm_cases.table(spark)) == brute(rows)
    assert pe.jaccard_components(llm_cases.empty(spark)).count() == 0


def test_prefixes_meet():
    """Linked sets share a signature in a band of both, whatever the order says."""
    r = np.random.default_rng(1)
    scheme = pe.Scheme()
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate([a[r.random(len(a)) > r.random() * 0.25], r.integers(0, 2**63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)])
        b = np.unique(b)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        counts = r.integers(0, 4, 1 << 10).astype(np.uint32)
        found = []
        for x in (a, b):
            band, k, low = scheme.bands(len(x))
            cells = pe.first_cells(x, max(k, low or 0) + 1, counts)
            found.append({(band, c) for c in cells[: k + 1]} | ({(band - 1, c) for c in cells[: low + 1]} if low is not None else set()))
        assert found[0] & found[1]


def test_bitmaps_never_rule_out_a_difference():
    """They tell at most the elements that are in one set only, and nearly all of them if those are few."""
    r = np.random.default_rng(3)
    for _ in range(600):
        n = int(r.integers(1, 2000))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate([a[r.random(len(a)) > r.random()], r.integers(0, 2**63, int(r.integers(1, n + 1))).astype(np.uint64)])
        b = np.unique(b)
        apart = len(np.setxor1d(a, b))
        told = pe.least_difference(pe.bitmap(a), pe.bitmap(b))
        assert told == pe.least_difference(pe.bitmap(b), pe.bitmap(a)) <= apart
        assert pe.least_difference(pe.bitmap(a), pe.bitmap(a)) == 0
        if n > 200 and apart > (len(a) + len(b)) // 3 and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
            assert told * 180 > (len(a) + len(b)) * 20


def test_one_row_of_each_group_stays(spark):
    df = llm_cases.table(spark)
    kept = pe.keep_one(df)
    assert kept.schema == df.schema
    ids = [LAST if r.doc_id is None else r.doc_id for r in kept.collect()]
    empty = kept.filter(F.trim(F.coalesce("text", F.lit(""))) == "").count()
    components_left = {c for _, n, c in brute([r[:2] for r in llm_cases.rows()]) if n}
    assert len(ids) - empty >= len(components_left) and components_left <= set(ids)
    again = pe.jaccard_components(kept.filter("doc_id <> 8")).filter("n_shingles > 0")
    assert again.groupBy("component").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_links(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: m for x, m in root.items() if x != m}
