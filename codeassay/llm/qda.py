"""Regularised quadratic discriminant over transformed document statistics.

Each class is a normal distribution of a fixed number of statistics. Counts, sums and sums of
products of the labelled rows are added up in Spark; the covariances shrink towards the pooled one
and that towards its diagonal. A score is the logistic of the difference of the two log densities
(Mahalanobis distances by cached Cholesky factors) and the log prior odds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.llm.common import by_text, in_batches, remainder, shared, stable, table

STATS = (
    "log_words", "mean_word", "sd_word", "symbols", "pipes", "exclaims", "digits", "upper", "capitalised", "repeated_next",
    "distinct", "top_word", "dup_lines", "words_per_line", "stops", "commas",
)
_SYMBOLS, _DIGITS, _UPPER = b"#*$%&<>@^~={}[]\\/_", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT = {c: bytes(set(range(256)) - set(c)) for c in (_SYMBOLS, _DIGITS, _UPPER, b"|", b"!", b".", b",")}
_CAPITALISED = re.compile(rb"(?:^|[\x20\x09-\x0D])[A-Z\xC3]")


def _count(text: bytes, of: bytes) -> int:
    return len(text.translate(None, _NOT[of]))


def statistics(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of one whole text: logs of sizes, square roots of shares.

    All are finite, for empty texts as well.
    """
    words = text.split()
    n = len(words) or 1
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        _count(text, _SYMBOLS) / n,
        _count(text, b"|") / n,
        _count(text, b"!") / n,
        _count(text, _DIGITS) / (len(text) or 1),
        _count(text, _UPPER) / (len(text) or 1),
        len(_CAPITALISED.findall(text)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        (len(lines) - len(set(lines))) / (len(lines) or 1),
    )
    tail = (
        np.log1p(len(words) / (len(lines) or 1)),
        np.sqrt(_count(text, b".") / n),
        np.sqrt(_count(text, b",") / n),
    )
    head = (np.log1p(len(words)), np.log1p(sizes.mean()), np.log1p(sizes.std()))
    return tuple(float(x) for x in (*head, *np.sqrt(shares), *tail))


stats_of = by_text(lambda texts: [statistics(t or b"") for t in texts], T.ArrayType(T.DoubleType()))


@dataclass(frozen=True)
class Regularisation:
    """Weight of the pooled covariance in each class, and of its diagonal in the pooled one."""

    pooled: float = 0.1
    diagonal: float = 0.05
    #: Added to every variance (statistics are standardised first).
    ridge: float = 1e-3
    #: Log odds are divided by it: statistics are not independent of each other.
    temperature: float = 2.0


@dataclass
class Model:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]
    prior: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if len(self.classes) < 2:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = [
            prior - 0.5 * (np.square((z - mean) @ inverse.T).sum(axis=1) + logdet)
            for prior, mean, inverse, logdet in self.classes
        ]
        odds = np.clip((logs[1] - logs[0]) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(features: DataFrame, rule: Regularisation = Regularisation()) -> Model:
    """Fit on ``features`` (x: array, label: 0 or 1), all rows.

    Tasks return their counts, sums and products for each class, a row of fixed size; Spark adds
    them up. With rows of one class only, or none, every score is that class's share (0.5).
    """
    d = len(STATS)
    width = 1 + d + d * d

    def rows(batches):
        total = np.zeros((2, width))
        for b in batches:
            if b["x"]:
                x, y = np.array(b["x"]), np.array(b["label"])
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield {"label": [0, 1], "m": total.tolist()}

    moments = in_batches(features.select("x", "label"), rows, "label int, m array<double>")
    summed = (
        moments.select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    )
    m = np.zeros((2, width))
    for r in summed:
        m[r.label, r.k] = r.v
    n, sums, products = m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :].reshape(2, d, d)
    everything = max(n.sum(), 1)
    prior = float(n[1] / everything) if n.sum() else 0.5
    centre = sums.sum(axis=0) / everything
    scale = np.sqrt(np.maximum(np.diagonal(products.sum(axis=0)) / everything - centre**2, 1e-12))
    if (n == 0).any():
        return Model(centre, scale, [], prior, rule.temperature)
    means = sums / n[:, None]
    cov = [(products[c] / n[c] - np.outer(means[c], means[c])) / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / everything
    pooled = (1 - rule.diagonal) * pooled + rule.diagonal * np.diag(np.diagonal(pooled))
    classes = []
    for c in (0, 1):
        # Few rows shrink further: as if ten rows for each statistic had come from the pool.
        weight = max(rule.pooled, 10 * d / (10 * d + n[c]))
        shrunk = (1 - weight) * cov[c] + weight * pooled + rule.ridge * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        classes.append(
            (
                float(np.log(n[c] / everything)),
                (means[c] - centre) / scale,
                np.linalg.inv(factor),
                float(2 * np.log(np.diagonal(factor)).sum()),
            )
        )
    return Model(centre, scale, classes, prior, rule.temperature)


def training_rows(features: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows of ``features`` (doc_id, x) with a label of 0 or 1 that may be learned from.

    A document with several labels counts for each; null ids and labels have none.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "label IN (0, 1)"
    )
    return features.filter(~F.col("held_out")).join(known, "doc_id").select("x", "label")


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 5) == 0


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rule: Regularisation = Regularisation()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, held_out, score.

    Only the text is scored; a null text counts as the empty one. The statistics of all texts are
    written once, for learning and scoring.
    """
    features = stable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), stats_of("text").alias("x"))
    )
    model = shared(docs.sparkSession, fit(training_rows(features, labels, label), rule))

    def rows(batches):
        for b in batches:
            scores = model().score(np.array(b["x"])) if b["x"] else []
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": list(map(float, scores))}

    return in_batches(features, rows, "doc_id long, held_out boolean, score double")


def op3_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
