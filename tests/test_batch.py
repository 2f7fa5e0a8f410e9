"""Batch statistics against plain Python, on skewed, empty and erroneous input."""

import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from codeassay.operators import batch
from codeassay.schemas import FAILURE_CATEGORIES, FAILURE_MODES, NO_FAILURE, RESPONSES
from test_modes import BITS, expected_modes, expected_quick


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(1500):
        model = "llama3" if i % 3 == 0 else rng.choice(["mistral", "qwen2.5-coder"])
        text = "".join(rng.choices(BITS, k=rng.randint(0, 14)))
        failed = rng.random() < 0.1
        out.append((i, "task_01", model, i % 5 + 1, None if failed else text, 1.0, "HTTP 500" if failed else None))
    out.append((1500, "task_01", "solo", 1, "sort", 1.0, None))
    return out


@pytest.fixture(scope="module")
def responses(spark, rows):
    return spark.createDataFrame(rows, RESPONSES).repartition(4)


@pytest.fixture(scope="module")
def kept(rows):
    return [r for r in rows if r[6] is None]


def test_errors_are_excluded(responses, kept):
    assert batch.scored_batch(responses).count() == len(kept)


def test_compliance_rate(responses, kept):
    row = batch.compliance_rate(batch.scored_batch(responses)).first()
    good = sum(expected_quick(r[4])[1] for r in kept)
    assert (row.total_runs, row.compliant, row.non_compliant) == (len(kept), good, len(kept) - good)
    assert row.compliant_rate == pytest.approx(100 * good / len(kept), abs=1e-6)
    assert row.compliant_rate + row.non_compliant_rate == pytest.approx(100)


def test_score_distribution(responses, kept):
    by_model = collections.defaultdict(list)
    for r in kept:
        by_model[r[2]].append(expected_quick(r[4])[0])
    got = {r.model: r for r in batch.score_distribution(batch.scored_batch(responses)).collect()}
    assert set(got) == set(by_model)
    for model, scores in by_model.items():
        r = got[model]
        assert (r.runs, r.min_score, r.max_score) == (len(scores), min(scores), max(scores))
        assert r.median_score == sorted(scores)[len(scores) // 2]  # the upper median
        assert r.mean_score == pytest.approx(statistics.fmean(scores), abs=1e-6)
        assert r.stddev_score == pytest.approx(statistics.pstdev(scores), abs=1e-6)
    assert got["solo"].stddev_score == 0.0


def mode_counts(kept):
    return collections.Counter(m for r in kept for m in expected_modes(r[4]))


def test_mode_distribution(responses, kept):
    counts = mode_counts(kept)
    got = batch.failure_mode_distribution(responses).collect()
    assert {r["mode"]: r["occurrences"] for r in got} == dict(counts)
    assert [r["occurrences"] for r in got] == sorted(counts.values(), reverse=True)
    for r in got:
        assert r["percent"] == pytest.approx(100 * counts[r["mode"]] / len(kept), abs=1e-6)


def test_category_rollup(responses, kept):
    counts = mode_counts(kept)
    got = {r.category: r.failures for r in batch.failure_category_rollup(responses).collect()}
    assert got == {c: sum(counts[m] for m in modes) for c, modes in FAILURE_CATEGORIES.items()}
    assert sum(got.values()) == sum(counts.values()) - counts[NO_FAILURE]


def test_summary(responses, kept):
    row = batch.batch_summary(responses).first()
    assert row.total_runs == len(kept) and row.failure_modes == dict(mode_counts(kept))
    assert row.mean_score == pytest.approx(statistics.fmean(expected_quick(r[4])[0] for r in kept), abs=1e-6)
    assert row.registered_models == ["qwen2.5-coder", "llama3", "mistral"]


def test_empty_batch(spark):
    none = spark.createDataFrame([], RESPONSES)
    row = batch.batch_summary(none).first()
    assert (row.total_runs, row.compliant_rate, row.mean_score, row.failure_modes) == (0, 0.0, 0.0, {})
    assert batch.compliance_rate(batch.scored_batch(none)).first().compliant_rate == 0.0
    assert batch.score_distribution(batch.scored_batch(none)).count() == 0
    assert batch.failure_mode_distribution(none).count() == 0
    assert {r.failures for r in batch.failure_category_rollup(none).collect()} == {0}


def test_mode_order_is_reporting_order():
    assert len(FAILURE_MODES) == 13 and FAILURE_MODES[0] == "signature_parameter_mismatch"


def test_grid_and_missing_cells(spark, responses, kept):
    grid = batch.evaluation_grid(spark, 6)
    cells = [(r.run, r.model) for r in grid.collect()]
    models = ("qwen2.5-coder", "llama3", "mistral")
    assert cells == [(n, m) for n in range(1, 7) for m in models]  # run-major
    done = {(r[3], r[2]) for r in kept}
    got = {(r.run, r.model) for r in batch.missing_cells(grid, responses).collect()}
    assert got == set(cells) - done
    assert batch.evaluation_grid(spark, 0).count() == 0


def test_routing(spark):
    df = spark.createDataFrame([("llama3", 0), ("other", 1), (None, 5), ("", -1)], "preferred string, index long")
    assert [r.model for r in batch.route_models(df).collect()] == ["llama3", "llama3", "mistral", "mistral"]
    with pytest.raises(ValueError):
        batch.route_models(df, [])


def test_latency_is_kept(responses):
    assert batch.scored_batch(responses).filter(F.col("latency_ms").isNull()).isEmpty()


@pytest.mark.parametrize("n_runs", [0, 1, 9, 70_000])
def test_unseen_cells_are_those_of_the_grid(spark, n_runs):
    """Runs on both sides of a slice's end, errors, other models, runs beyond the grid, repeated cells."""
    r = random.Random(n_runs)
    runs = [r.randint(1, 70_000) for _ in range(3000)] + [1, 2, 8, 9, 32768, 32769, 65536, 65537, 70_000, 70_001, 0, -5] * 3
    rows = [(i, "t", r.choice(["llama3", "mistral", "other"]), run, "x", 1.0, "e" if r.random() < 0.3 else None) for i, run in enumerate(runs)]
    rows += [(10_000 + k, "t", "qwen2.5-coder", k, "x", 1.0, None) for k in range(1, 32769)]  # a slice without gaps
    df = spark.createDataFrame(rows, RESPONSES)
    got = batch.unseen_cells(df, n_runs)
    want = batch.missing_cells(batch.evaluation_grid(spark, n_runs), df)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
