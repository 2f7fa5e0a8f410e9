"""Host-level quality rules: how often a host's documents fail decides how a failure counts.

Every document is measured once. Rule failures are summed by host (the ``source`` column), each
host's failure rate is shrunk with a beta prior fitted to all hosts (method of moments), and the
verdict on (host, rule) is joined back to the documents that fail the rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.llm.common import by_text, fresh, small_batches, stable, struct_of, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
)
#: What a rule sees: the statistics as columns, by name.
Stats = Mapping[str, Column]
#: Integer conditions, so that engines agree: name -> (failing, failing by half the limit).
RULES: dict[str, Callable[[Stats], tuple[Column, Column]]] = {
    "symbols": lambda c: (5 * c["n_symbols"] > c["n_words"], 10 * c["n_symbols"] > c["n_words"]),
    "upper_case": lambda c: (2 * c["n_upper"] > c["n_letters"], 4 * c["n_upper"] > c["n_letters"]),
    "dup_lines": lambda c: (10 * c["n_dup_lines"] > 3 * c["n_lines"], 20 * c["n_dup_lines"] > 3 * c["n_lines"]),
    "word_length": lambda c: (
        (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
        (2 * c["word_chars"] < 5 * c["n_words"]) | (c["word_chars"] > 16 * c["n_words"]),
    ),
}


def base_failed(c: Stats) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


@dataclass(frozen=True)
class Verdicts:
    """Limits on a host's shrunk failure rate of one rule.

    Up to ``trusted`` a single failure is taken for chance and the document stays. Up to
    ``blocked`` failing documents go. Beyond it documents also go at half the rule's limit.
    """

    trusted: float = 0.01
    blocked: float = 0.9


_UPPER = re.compile(rb"[A-Z]+")
_LETTERS = re.compile(rb"[A-Za-z]+")
_KEEP_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))


def _length(pieces: list[bytes]) -> int:
    return sum(map(len, pieces))


def measure(text: bytes) -> tuple[int, ...]:
    """The statistics named in STATS of one whole text."""
    words = text.split()
    joined = b"".join(words)
    n_lines, dup, seen = 0, 0, set()
    for line in text.split(b"\n"):
        n_lines += 1
        if line.strip():
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(*(words[k:] for k in range(WINDOW)), strict=False)) if len(words) > WINDOW else {}
    repeated = 0
    if windows and len(windows) < len(words) - WINDOW + 1:
        end = 0  # words before it are counted
        for i, w in enumerate(zip(*(words[k:] for k in range(WINDOW)), strict=False)):
            if windows[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(text.translate(None, _KEEP_SYMBOLS)),
        dup,
        repeated,
        n_lines,
        _length(_UPPER.findall(text)),
        _length(_LETTERS.findall(text)),
    )


#: The statistics of a text column, as a struct.
stats_of = by_text(lambda texts: [measure(t or b"") for t in texts], struct_of(T.LongType(), *STATS))


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, host, stats) per row; a null text has no words and one line, a null host is ''."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), stats_of("text").alias("stats")
    )


def _columns(struct: str) -> Stats:
    return {name: F.col(struct)[name] for name in STATS}


def host_verdicts(stats: DataFrame, limits: Verdicts = Verdicts()) -> DataFrame:
    """One row per host and rule: documents, failures, shrunk rate and verdict.

    Prior of each rule: mean and variance of the hosts' rates, weighted by their documents; its
    strength is kept between 1 and a million documents. Rows without a host form one.
    """
    per_host = stats.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.count_if(rule(_columns("stats"))[0]).alias(name) for name, rule in RULES.items()],
    )
    per_rule = per_host.select(
        "host",
        "docs",
        F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "failures"),
    ).withColumn("rate", F.col("failures") / F.col("docs"))
    moments = per_rule.groupBy("rule").agg(
        (F.sum("failures") / F.sum("docs")).alias("mean"),
        F.sum("docs").alias("all_docs"),
        F.sum(F.col("docs") * F.col("rate") * F.col("rate")).alias("squares"),
    )
    prior = moments.select(
        "rule",
        "mean",
        F.expr("squares / all_docs - mean * mean").alias("variance"),
    ).selectExpr(
        "rule",
        "mean",
        "CASE WHEN variance <= 0 THEN 1e6 ELSE greatest(1.0D, least(1e6, mean * (1 - mean) / variance - 1)) END AS strength",
    )
    rate = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    return (
        per_rule.join(prior, "rule")
        .withColumn("shrunk", rate)
        .withColumn(
            "verdict",
            F.when(F.col("shrunk") <= limits.trusted, "trusted")
            .when(F.col("shrunk") > limits.blocked, "blocked")
            .otherwise("normal"),
        )
        .select("host", "rule", "docs", "failures", "shrunk", "verdict")
    )


def _verdict_maps(stats: DataFrame, limits: Verdicts) -> DataFrame:
    """One row per host with its verdict on each rule, as a written table.

    Spark knows the size of what it reads back and broadcasts it only while it is small.
    """
    maps = F.map_from_entries(F.collect_list(F.struct("rule", "verdict"))).alias("verdicts")
    return stable(host_verdicts(stats, limits).groupBy("host").agg(maps))


def _rejecting(stats: str, verdicts: str) -> Column:
    """Names of the rules that reject a row."""
    found = []
    for name, rule in RULES.items():
        fails, strict = rule(_columns(stats))
        verdict = F.col(verdicts)[name]
        found.append(F.when((fails & (verdict != "trusted")) | (strict & (verdict == "blocked")), name))
    return F.array_compact(F.array(*found))


def host_rules(docs: DataFrame, limits: Verdicts = Verdicts()) -> DataFrame:
    """doc_id, the statistics, base_failed, failed (rules that reject the row) and kept, per row.

    ``docs`` needs doc_id, source and text; further columns are ignored.
    """
    stats = stable(text_stats(docs))
    return (
        stats.join(_verdict_maps(stats, limits), "host", "left")
        .withColumn("base_failed", base_failed(_columns("stats")))
        .withColumn("failed", _rejecting("stats", "verdicts"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .select("doc_id", "stats.*", "base_failed", "failed", "kept")
    )


def keep_good(docs: DataFrame, limits: Verdicts = Verdicts()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns unchanged.

    Each text is measured once: the rows are written with their statistics, which both the sums of the
    hosts and the filter read (columns apart, so no text is read for the sums). A null text has no
    words and goes; rows without a host form one.
    """
    stats, host, maps = (fresh(docs, name) for name in ("_stats", "_host", "_verdicts"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    with small_batches(docs.sparkSession):
        measured = stable(docs.select(*names, _host().alias(host), stats_of("text").alias(stats)))
    verdicts = _verdict_maps(measured.select(F.col(host).alias("host"), F.col(stats).alias("stats")), limits)
    return (
        measured.join(verdicts.select(F.col("host").alias(host), F.col("verdicts").alias(maps)), host, "left")
        .filter(~base_failed(_columns(stats)) & (F.size(_rejecting(stats, maps)) == 0))
        .select(*names)
    )


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the statistics, base_failed and kept."""
    judged = host_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS k
  FROM w, unnest(range(1, len(ws) - 3)) AS t(i)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, unnest(range(0, 5)) AS t(j) GROUP BY rid
),
worded AS (
  SELECT rid, line FROM (SELECT rid, unnest(ls) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY rid),
s AS (
  SELECT w.doc_id, host, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN repeated USING (rid) LEFT JOIN dups USING (rid)
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         5 * n_symbols > n_words AS f1, 10 * n_symbols > n_words AS s1,
         2 * n_upper > n_letters AS f2, 4 * n_upper > n_letters AS s2,
         10 * n_dup_lines > 3 * n_lines AS f3, 20 * n_dup_lines > 3 * n_lines AS s3,
         word_chars < 2 * n_words OR word_chars > 20 * n_words AS f4,
         2 * word_chars < 5 * n_words OR word_chars > 16 * n_words AS s4
  FROM s
),
hosts AS (
  SELECT host, rule, count(*) AS docs, count(*) FILTER (WHERE failing) AS failures
  FROM (SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS failing FROM f)
  GROUP BY host, rule
),
prior AS (
  SELECT rule, mean, CASE WHEN variance <= 0 THEN 1e6
                          ELSE greatest(1.0, least(1e6, mean * (1 - mean) / variance - 1)) END AS strength
  FROM (
    SELECT rule, sum(failures)::DOUBLE / sum(docs) AS mean,
           sum(docs * (failures::DOUBLE / docs) * (failures::DOUBLE / docs)) / sum(docs)
             - (sum(failures)::DOUBLE / sum(docs)) * (sum(failures)::DOUBLE / sum(docs)) AS variance
    FROM hosts GROUP BY rule
  )
),
v AS (
  SELECT host, rule, (failures + mean * strength) / (docs + strength) AS shrunk FROM hosts JOIN prior USING (rule)
),
pivoted AS (
  SELECT host, max(shrunk) FILTER (WHERE rule = 1) AS v1, max(shrunk) FILTER (WHERE rule = 2) AS v2,
         max(shrunk) FILTER (WHERE rule = 3) AS v3, max(shrunk) FILTER (WHERE rule = 4) AS v4
  FROM v GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT (f1 AND v1 > 0.01 OR s1 AND v1 > 0.9) AND NOT (f2 AND v2 > 0.01 OR s2 AND v2 > 0.9)
       AND NOT (f3 AND v3 > 0.01 OR s3 AND v3 > 0.9) AND NOT (f4 AND v4 > 0.01 OR s4 AND v4 > 0.9) AS kept
FROM f JOIN pivoted USING (host)
"""
