"""Interaction of filters: what each would remove in any order, by a walk over all sets of filters.

Every document is tested once against all filters; what fails is a bit mask. Documents are counted by part
and mask, which leaves at most 2**k cells of a part for k filters. A Gray code then visits all sets of active
filters and toggles one filter at a time: each cell counts how many active filters it fails, and the running
survivors change by the cells whose count leaves or reaches zero. The 2**k states are stored; what a
filter removes at a step of an order is the difference of two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.llm.common import by_text, discard, order_id, stable, table

#: Letters of the filters; the k-th one is bit k of a mask. The last one is about the whole table.
FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text fails."""
    words = text.split()
    few = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * len(text.translate(None, _NOT_UPPER)) > 10 * len(text.translate(None, _CONTINUATION))
    return few | repeated << 1 | capitals << 2 | (_SYMBOL.search(text) is not None) << 3


_mask_of = by_text(lambda texts: [failures(t or b"") for t in texts], T.IntegerType())


def failing(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) per row, as a written table; ``mask`` knows A to D.

    A null text counts as empty, a null language as ''.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return stable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            _mask_of("text").alias("mask"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic; an id with several labels has what any of them says, no id has none."""
    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna(subset=["doc_id"])
    known = flags.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    without = rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return rows.filter("doc_id is not null").join(known, "doc_id", "left").fillna(False, ["good", "toxic"]).unionByName(without)


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by all the filters they fail.

    Filter E fails where a smaller id has the same text anywhere in the table. Copies are counted by text
    and kind before the smallest id is looked up, so a text of a third of all rows is a few rows there.
    """
    kind = ("digest", "mask", "part", "good", "toxic")
    by_id = _labelled(rows, labels).groupBy(*kind, order_id().alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counted = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    owners = counted.groupBy("digest").agg(F.min("least.id").alias("owner"))
    first = F.when(F.col("least.id") == F.col("owner"), F.col("least.n")).otherwise(F.lit(0).cast("long"))
    split = F.array(
        F.struct("mask", first.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - first).alias("n")),
    )
    parted = counted.join(owners, "digest").select("part", "good", "toxic", F.inline(split)).filter("n > 0")

    def among(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0).cast("long")))

    return parted.groupBy("part", "mask").agg(F.sum("n").alias("n"), among("good").alias("good"), among("toxic").alias("toxic"))


def gray_walk(masks: Sequence[int], counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of each set of active filters: row s of the result is for the set with bits s.

    ``counts`` has a row for each cell and a column for each measure.
    """
    masks = np.asarray(masks, np.int64)
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0] = running
    state = 0
    for i in range(1, 1 << k):
        bit = i & -i  # the filter that this step of the Gray code toggles
        touched = (masks & bit) != 0
        state ^= bit
        if state & bit:
            running = running - counts[touched & (active == 0)].sum(axis=0)
            active += touched
        else:
            active -= touched
            running = running + counts[touched & (active == 0)].sum(axis=0)
        states[state] = running
    return states


def steps(part: str, masks: Sequence[int], counts: np.ndarray, filters: str = FILTERS) -> Iterator[tuple]:
    """One row per order of the filters and step; ``counts`` has the columns n, good and toxic."""
    states = gray_walk(masks, counts, len(filters))
    masks = np.asarray(masks, np.int64)
    fails = {f: int(counts[(masks >> k) & 1 == 1, 0].sum()) for k, f in enumerate(filters)}
    alone = {f: int(counts[masks == 1 << k, 0].sum()) for k, f in enumerate(filters)}
    shapley = dict.fromkeys(filters, 0)
    found = []
    for order in permutations(filters):
        state = 0
        for step, f in enumerate(order, 1):
            after = state | 1 << filters.index(f)
            removed, good, toxic = (int(x) for x in states[state] - states[after])
            shapley[f] += removed
            found.append(("".join(order), step, f, int(states[after][0]), removed, good, toxic))
            state = after
    for order, step, f, kept, removed, good, toxic in found:
        yield part, order, step, kept, removed, fails[f] - removed, alone[f], good, toxic, shapley[f]


SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def interactions(counted: DataFrame) -> DataFrame:
    """The steps of all orders of each part of ``cells``. A part has at most 2**k cells."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def of_part(group: pd.DataFrame) -> pd.DataFrame:
        counts = group[["n", "good", "toxic"]].to_numpy(np.int64)
        return pd.DataFrame(list(steps(group["part"].iloc[0], group["mask"].tolist(), counts)), columns=names)

    return counted.groupBy("part").applyInPandas(of_part, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The steps of all 120 orders of the five filters, for each language of ``docs``.

    ``docs`` needs doc_id, text and lang, ``labels`` doc_id, quality and toxic; further columns are
    ignored. Repeated rows count each and are no copies of one another; a null id is larger than
    all others and has no labels. An empty table has no parts and gives no rows.
    """
    rows = failing(docs)
    counted = stable(cells(rows, labels))
    discard(rows)
    return interactions(counted)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner
  FROM documents
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM (
    SELECT part, good, toxic,
           (len(ws) < 100)::INT + 2 * (100 * list_unique(ws) < 80 * len(ws))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * coalesce(owner < coalesce(d.doc_id, 9223372036854775807), false)::INT AS mask
    FROM d LEFT JOIN l USING (doc_id)
  )
  GROUP BY part, mask
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS letters, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT array_to_string(letters, '') AS filter_order, step, bits[step] AS bit,
         coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior
  FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
),
found AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (prior | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & prior > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps
  GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
