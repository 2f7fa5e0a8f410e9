import zlib

import llm_cases
import numpy as np

from codeassay.llm import qda

LABELS = "doc_id long, quality int, toxic int"


def test_statistics_are_finite():
    for row in llm_cases.rows():
        s = qda.statistics((row[1] or "").encode())
        assert len(s) == len(qda.STATS) and np.isfinite(s).all()


def features(spark, x, y):
    return spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int")


def test_scores_are_log_density_differences(spark):
    """Against the textbook formula, with the covariances inverted directly."""
    r = np.random.default_rng(0)
    d = len(qda.STATS)
    y = (r.random(900) < 0.7).astype(int)
    x = r.normal(size=(900, d)) @ r.normal(size=(d, d)) + y[:, None] * 0.3
    rule = qda.Regularisation(temperature=1.0)
    model = qda.fit(features(spark, x, y).repartition(4), rule)
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / len(y)
    pooled = (1 - rule.diagonal) * pooled + rule.diagonal * np.diag(np.diag(pooled))
    logs = []
    for c in (0, 1):
        w = max(rule.pooled, 10 * d / (10 * d + n[c]))
        s = (1 - w) * cov[c] + w * pooled + rule.ridge * np.eye(d)
        e = z - z[y == c].mean(0)
        logs.append(np.log(n[c] / len(y)) - 0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_held_out_accuracy(spark):
    found = qda.op3_quadratic_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = found.filter("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.95


def test_odd_rows_and_labels(spark):
    docs = llm_cases.table(spark)
    ids = [r[0] for r in llm_cases.rows()]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], LABELS)
    found = qda.score_quality(docs, labels).collect()
    assert len(found) == len(ids)
    for r in found:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(text.encode()) % 5 == 0)
    assert qda.score_quality(llm_cases.empty(spark), labels).count() == 0
    none = qda.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = qda.score_quality(docs, labels.filter("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}


def test_held_out_labels_teach_nothing(spark):
    docs = llm_cases.table(spark).filter("doc_id >= 100")
    ids = sorted({r[0] for r in llm_cases.rows() if r[0] is not None and r[0] >= 100})
    one = spark.createDataFrame([(i, i % 2, 0) for i in ids], LABELS)
    other = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2, 0) for i in ids], LABELS)
    score = lambda labels: sorted((r.doc_id, round(r.score, 12)) for r in qda.score_quality(docs, labels).collect())
    assert score(one) == score(other)
