"""Block-wise and sorted group operations against plain Python, with a hot group and tiny blocks."""

import random

import pytest
from pyspark.sql import functions as F

from codeassay.operators import skew


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for group, n in (("hot", 400), ("b", 7), ("c", 1), (None, 30)):
        for pos in rng.sample(range(1000), n):
            out.append((group, pos, rng.choice([None, None, pos * 10])))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([r for r in rows if r[0]], "g string, pos int, v int")


@pytest.mark.parametrize("block", [1, 8, 65536])
def test_ordinal(frame, rows, block):
    got = {(r.g, r.pos): r.n for r in skew.ordinal(frame, "g", "pos", "n", block).collect()}
    for group in ("hot", "b", "c"):
        ordered = sorted(p for g, p, _ in rows if g == group)
        assert [got[group, p] for p in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("block", [1, 8, 65536])
def test_carry_forward(frame, rows, block):
    got = {(r.g, r.pos): r.p for r in skew.carry_forward(frame, "g", "pos", "v", "p", block).collect()}
    for group in ("hot", "b", "c"):
        last = None
        for _, pos, value in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            assert got[group, pos] == last
            last = value if value is not None else last


def test_carry_forward_struct(frame):
    boxed = frame.withColumn("s", F.when(F.col("v").isNotNull(), F.struct("v", "g")))
    plain = skew.carry_forward(frame, "g", "pos", "v", "p", 8).select("g", "pos", "p")
    got = skew.carry_forward(boxed, "g", "pos", "s", "q", 8).select("g", "pos", F.col("q.v").alias("p"))
    assert plain.exceptAll(got).isEmpty() and got.exceptAll(plain).isEmpty()


def test_rank_in_groups(spark, rows):
    """A hot group spreads over several partitions; null groups rank too."""
    df = spark.createDataFrame(rows, "g string, pos int, v int").repartition(5)
    ranked = skew.rank_in_groups(df, ["g"], [F.col("v").desc_nulls_last(), "pos"], "rank").collect()
    assert len(ranked) == len(rows)
    for group in ("hot", "b", "c", None):
        mine = sorted((r for r in ranked if r.g == group), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.v, r.pos) for r in mine] == sorted(
            ((r.v, r.pos) for r in mine), key=lambda k: (k[0] is None, -(k[0] or 0), k[1])
        )


def test_rank_spans_partitions(spark):
    """Without coalescing, one group really covers many partitions of the sort."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.lit(5000) - F.col("id")).alias("k"))
        ranked = skew.rank_in_groups(df, ["g"], ["k"], "rank")
        by_group = ranked.groupBy("g").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("lo")).collect()
        assert {(r.n, r.lo) for r in by_group} == {(2500, 1)}
        order = ranked.alias("a").join(ranked.alias("b"), F.expr("a.g = b.g and b.rank = a.rank + 1"))
        assert order.filter("a.k >= b.k").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_salted_equals_broadcast(spark, how):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("absent", 3)], "k string, w int")
    small = skew.lookup_join(facts, lookup, "k", how, ["id"])
    salted = skew.lookup_join(facts, lookup, "k", how, ["id"], max_bytes=0)
    assert [tuple(r) for r in skew.hot_keys(facts, "k").collect()] == [("hot", 3)]  # 1000 rows, 375 per partition
    assert "_salt" in salted._jdf.queryExecution().toString()
    unkeyed = spark.range(50).select(F.lit(None).cast("string").alias("k"), "id")
    assert skew.lookup_join(unkeyed, lookup, "k", how, ["id"], max_bytes=0).count() == (50 if how == "left" else 0)
    even = skew.lookup_join(facts.filter("k <> 'hot'"), lookup, "k", how, ["id"], max_bytes=0)
    assert even.count() == small.filter("k <> 'hot'").count()
    assert small.count() == salted.count()
    assert small.exceptAll(salted.select(*small.columns)).isEmpty()


def test_size_measure(spark):
    df = spark.createDataFrame([("k", "x" * 1000, ["a"])], "k string, t string, a array<string>")
    assert skew.fits_broadcast(df, 2000) and not skew.fits_broadcast(df, 1000)


@pytest.mark.parametrize("block", [10, 65536])
def test_sparse_64_bit_positions(spark, block, monkeypatch):
    """Every row is its own block, far apart; nodes of the tree have four children."""
    monkeypatch.setattr(skew, "FAN_BITS", 16 if block > 10 else 8)
    r = random.Random(6)
    rows = [("hot", p, r.choice([None, p])) for p in r.sample(range(-(2**40), 2**62), 300)] + [("b", 5, 7), ("b", 2**61, None), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, pos long, v long")
    numbered = {(x.g, x.pos): x.n for x in skew.ordinal(df, "g", "pos", "n", block).collect()}
    carried = {(x.g, x.pos): x.p for x in skew.carry_forward(df, "g", "pos", "v", "p", block).collect()}
    assert len(numbered) == len(carried) == len(rows)
    for g in ("hot", "b", "c"):
        last = None
        for k, (_, pos, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1]), 1):
            assert (numbered[g, pos], carried[g, pos]) == (k, last)
            last = v if v is not None else last


def test_no_job_runs_while_a_block_wise_query_is_built(spark, frame):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    df = skew.ordinal(skew.carry_forward(frame, "g", "pos", "v", "p", 10), "g", "pos", "n", 10)
    assert not tracker.getJobIdsForGroup("building")
    assert df.count() > 0 and tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")


def test_windows_of_summaries_are_bounded(spark):
    """Blocks of a hot group, each of one row: no window sees more than the children of one node."""
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 1000).alias("pos"), F.lit(1).alias("v"))
    blocks = df.select("g", skew.block_of("pos", 10).alias("_block"), "v").groupBy("g", "_block").agg(F.count("v").alias("_v"))
    sums = skew._scan_blocks(blocks, "g", 60, lambda v, at: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.sum)
    assert sums.filter("_block > 0").count() == 4999
    assert sums.orderBy(F.desc("_block")).first()["_before"] == 4999
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_up#") > 0 and plan.count("Window [") >= 4


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_number_in_groups(spark, slices):
    """Groups over many slices, null groups and keys, long texts that agree in their first characters."""
    r = random.Random(slices)
    names = [None, "", "a", "b" * 200 + "x", "b" * 200 + "y", "b" * 200, "é", "Z"]
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice(names), i) for i in range(3000)] + [("c", "one", -1)]
    df = spark.createDataFrame(rows, "g string, name string, pos long").repartition(6)
    want = {}
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, (x[1] or "").encode(), x[2]))
        want |= {x: k for k, x in enumerate(mine, 1)}
    for parts in (6, 3):  # the same however the rows lie
        got = skew.number_in_groups(df.repartition(parts), ["g"], ["name", "pos"], "n", slices).collect()
        assert len(got) == len(rows) and {(x.g, x.name, x.pos): x.n for x in got} == want
    bounds = skew.range_bounds(df, ["g", "name", "pos"], slices)
    assert len(bounds) <= slices + 1 and (slices < 7 or len(bounds) > slices // 2)
    assert all(len(b[1] or "") <= skew.BOUND_CHARS for b in bounds)
    sizes = [x["count"] for x in df.groupBy(skew.slice_of(df, ["g", "name", "pos"], bounds).alias("s")).count().collect()]
    assert sum(sizes) == len(rows) and (slices < 7 or max(sizes) < 3 * len(rows) / len(bounds) + 100)


def test_numbering_writes_nothing_and_stays_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "stable", None)
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.lit(5000) - F.col("id")).alias("k"))
    ranked = skew.number_in_groups(df, ["g"], ["k"], "n", 16)
    first = sorted(map(tuple, ranked.collect()))
    assert first == sorted(map(tuple, ranked.collect()))  # a job that runs again
    assert [n for g, _, n in first if g == 0] == list(range(1, 2501))


def test_numbering_no_rows(spark):
    assert skew.number_in_groups(spark.createDataFrame([], "g string, k int"), ["g"], ["k"], "n").count() == 0
