"""Hierarchical budgeting of a token mixture, in DataFrame operations only.

A tree of domain, language and source carries target weights. The budget of a node is dealt to its
children in proportion to their weights, but never beyond what they can supply (their documents,
repeated ``max_epochs`` times at most). What one child lacks goes to its siblings, and only what
all of them lack together is missing above, where the same rule shares it among the parent's
siblings. A leaf takes whole epochs of its documents and a prefix of one more, in an order that the
seed and the number of the epoch fix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeassay.llm.common import fresh, stable, table

LEVELS = ("domain", "lang", "source")
#: Leading hexadecimal digits of the order key by which a leaf is sliced, then its last slice.
SLICE_DIGITS = (2, 4)


@dataclass(frozen=True)
class Mixture:
    """Budget in percent of the tokens at hand, weights and seed.

    A node's weight is its share among its siblings: its entry in ``weights`` for its level and
    name, or else its tokens to the power ``flatten`` (1: as they are, 0: all alike).
    """

    budget_percent: int = 100
    max_epochs: int = 3
    flatten: float = 0.5
    seed: int = 17
    long_words: int = 300
    weights: tuple[tuple[str, str, float], ...] = (("domain", "long", 0.7), ("domain", "short", 0.3))


def n_words(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text: separators before a word, counted natively."""
    worded = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(worded, r"[\x20\x09-\x0D]+", "")).cast("long")


def leaf_columns(mixture: Mixture, text: str = "text") -> dict[str, Column]:
    """Tokens (words and one end), the tree's levels (null: '') and the id by which rows are ordered.

    ``own`` is doc_id and the text's MD5, so rows are ordered alike unless they are equal.
    """
    words = n_words(text)
    return {
        "tokens": words + 1,
        "domain": F.when(words >= mixture.long_words, "long").otherwise("short"),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "own": F.concat_ws(
            "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))
        ),
    }


def order_key(seed: int, epoch: Column, own: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), epoch.cast("string"), own))


def _weight(level: str, mixture: Mixture) -> Column:
    given = [(name, w) for lev, name, w in mixture.weights if lev == level]
    natural = F.pow(F.col("tokens"), F.lit(float(mixture.flatten)))
    return reduce(lambda c, x: F.when(F.col(level) == x[0], F.lit(float(x[1]))).otherwise(c), given, natural)


def _deal(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``budget`` of each child from its parent's ``given``, its weight and its capacity.

    With children in ascending order of capacity over weight, those before the first one whose
    share fits are filled to capacity, and the rest share what remains by weight. (Shares only
    fall after the first that fits, so it is the largest of those that fit.)
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("ratio", level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    return (
        children.withColumn("ratio", ratio)
        .withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("given") - F.col("filled")) / F.col("weight_left"))
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(whole))
        .withColumn(
            "budget",
            F.least(F.col("capacity").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("capacity"))),
        )
        .drop("ratio", "filled", "weight_left", "level_here", "level")
    )


def leaf_budgets(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """One row per leaf: tokens, budget, full epochs and tokens of the epoch that is cut.

    ``rows`` has the tree's levels and tokens. The tree is an aggregate of all rows.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    tree: list[DataFrame] = []
    for depth in range(1, len(LEVELS) + 1):
        names = LEVELS[:depth]
        nodes = leaves.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
        tree.append(nodes.withColumn("capacity", F.col("tokens") * mixture.max_epochs).withColumn("weight", _weight(names[-1], mixture)))
    root = leaves.agg(F.sum("tokens").alias("all")).select(
        F.lit(0).alias("root"), F.least(F.col("all") * mixture.budget_percent / 100.0, F.col("all") * mixture.max_epochs * 1.0).alias("given")
    )
    top = tree[0].withColumn("root", F.lit(0)).join(root, "root")
    dealt = _deal(top, ["root"], LEVELS[0])
    for depth in range(1, len(LEVELS)):
        above = dealt.select(*LEVELS[:depth], F.col("budget").alias("given"))
        dealt = _deal(tree[depth].join(above, list(LEVELS[:depth])), list(LEVELS[:depth]), LEVELS[depth])
    full = F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(mixture.max_epochs))
    return (
        dealt.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))
        .withColumn("full_epochs", full.cast("int"))
        .withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))
    )


def leaf_cuts(slim: DataFrame, mixture: Mixture) -> DataFrame:
    """The leaves' budgets with ``cut``: the last order key of the token prefix, or a bound for it.

    The keys' leading digits are summed first, two at a time: the 256 sums of a leaf tell in which
    of its slices the budget ends, and only that slice is looked at further. Rows are sorted one by
    one only in a 65,536th of a leaf, so a leaf with a third of all rows is no large window.
    """
    leaf = list(LEVELS)
    budgets = stable(leaf_budgets(slim, mixture))
    # Read back from a written table: Spark knows its size.
    keyed = slim.join(budgets.select(*LEVELS, "full_epochs", "rest"), leaf).select(
        *LEVELS, "tokens", "rest", order_key(mixture.seed, F.col("full_epochs"), F.col("own")).alias("key")
    )
    found = budgets.select(*LEVELS, F.lit("").alias("slice"), F.lit(0).cast("long").alias("before"))
    running = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    for digits in SLICE_DIGITS:
        inside = _inside(keyed, found).withColumn("slice", F.substring("key", 1, digits))
        slices = inside.groupBy(*LEVELS, "slice").agg(
            F.sum("tokens").alias("t"), F.max("rest").alias("rest"), F.max("before").alias("before")
        )
        upto = slices.withColumn("upto", F.col("before") + F.sum("t").over(running))
        end = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("slice", (F.col("upto") - F.col("t")).alias("before"))))
        # A leaf whose epoch fits as a whole leaves the search.
        found = stable(upto.groupBy(*LEVELS).agg(end.alias("e")).filter("e IS NOT NULL").select(*LEVELS, "e.slice", "e.before"))
    by_row = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        _inside(keyed, found)
        .withColumn("upto", F.col("before") + F.sum("tokens").over(by_row))
        .filter("upto <= rest")
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("key"))
    )
    # 'g' is after every key; a slice is before its own keys and after those of the slices before.
    cut = F.coalesce("key", "slice", F.lit("g"))
    ends = found.drop("before").join(last, leaf, "left")
    return stable(budgets.join(ends, leaf, "left").withColumn("cut", cut).drop("slice", "key"))


def _inside(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the slice in which their leaf's budget ends, with the tokens before it."""
    joined = keyed.join(found.select(*LEVELS, "slice", "before"), list(LEVELS))
    return joined.filter(F.col("key").startswith(F.col("slice"))).drop("slice")


def _epochs(mixture: Mixture) -> Column:
    """How often a row is taken."""
    partial = (F.col("rest") > 0) & (order_key(mixture.seed, F.col("full_epochs"), F.col("own")) <= F.col("cut"))
    return F.col("full_epochs") + F.when(partial, 1).otherwise(0)


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """Per row of ``docs`` that is taken: doc_id, domain, lang, source, tokens, epochs.

    Needs doc_id, text, lang and source; others are ignored. Rows that tie in the order (equal in
    id and text) are taken together or not at all. Null texts are one token, the end.
    """
    columns = leaf_columns(mixture)
    slim = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in columns.items()]))
    cuts = leaf_cuts(slim, mixture).select(*LEVELS, "full_epochs", "rest", "cut")
    taken = slim.join(cuts, list(LEVELS)).withColumn("epochs", _epochs(mixture)).filter("epochs > 0")
    return taken.select("doc_id", *LEVELS, "tokens", "epochs")


def take_mixture(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs`` that are taken, each as often as its epochs, with all their columns.

    Only the leaves' cuts meet the texts, so no text is shuffled. Null languages and sources count as empty
    ones, a null text as one token; rows equal in id and text tie in the order and are taken together.
    """
    names = leaf_columns(mixture)
    slim = stable(docs.select(*[c.alias(n) for n, c in names.items()]))
    cuts = leaf_cuts(slim, mixture).select(*LEVELS, "full_epochs", "rest", "cut")
    row = fresh(docs, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[c.alias(n) for n, c in names.items()])
    taken = packed.join(cuts, list(LEVELS)).withColumn("epochs", _epochs(mixture)).filter("epochs > 0")
    repeated = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return repeated.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql(m: Mixture) -> str:
    def weight(level: str) -> str:
        given = "".join(f" WHEN {level} = '{n}' THEN {w}" for lev, n, w in m.weights if lev == level)
        natural = f"pow(tokens, {m.flatten})"
        return f"CASE{given} ELSE {natural} END" if given else natural

    def deal(name: str, level: str, parent: list[str], above: str) -> str:
        part = ", ".join(parent) or "1"
        cols = ", ".join([*parent, level])
        given = f"(SELECT given FROM {above})" if not parent else "a.budget"
        join = f"JOIN {above} a USING ({part})" if parent else ""
        return f"""
{name}_n AS (
  SELECT {cols}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {m.max_epochs} AS capacity FROM leaves GROUP BY {cols}
),
{name}_w AS (SELECT n.*, {weight(level).replace("tokens", "n.tokens").replace(f" {level} =", f" n.{level} =")} AS weight, {given} AS given FROM {name}_n n {join}),
{name}_r AS (
  SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM {name}_w
),
{name}_l AS (
  SELECT *, (given - coalesce(sum(capacity) OVER b, 0))
            / (sum(weight) OVER (PARTITION BY {part}) - coalesce(sum(weight) OVER b, 0)) AS here
  FROM {name}_r
  WINDOW b AS (PARTITION BY {part} ORDER BY ratio, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name} AS (
  SELECT {cols}, tokens,
         least(capacity::DOUBLE, coalesce(max(here) FILTER (WHERE here <= ratio) OVER (PARTITION BY {part}) * weight, capacity)) AS budget
  FROM {name}_l
),"""

    return rf"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS own
  FROM documents
),
rows_ AS (SELECT *, words + 1 AS tokens, CASE WHEN words >= {m.long_words} THEN 'long' ELSE 'short' END AS domain FROM d),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
root AS (
  SELECT least(sum(tokens) * {m.budget_percent} / 100.0::DOUBLE, sum(tokens) * {m.max_epochs}::DOUBLE) AS given FROM leaves
),{deal("t1", "domain", [], "root")}{deal("t2", "lang", ["domain"], "t1")}{deal("t3", "source", ["domain", "lang"], "t2")}
leaf AS (
  SELECT domain, lang, source, floor(budget + 1e-6)::BIGINT AS budget, tokens AS leaf_tokens,
         least(floor(budget / tokens), {m.max_epochs})::BIGINT AS full_epochs
  FROM t3
),
keyed AS (
  SELECT r.*, full_epochs, budget - full_epochs * leaf_tokens AS rest,
         md5(concat_ws('|', '{m.seed}', full_epochs::VARCHAR, own)) AS key
  FROM rows_ r JOIN leaf USING (domain, lang, source)
),
taken AS (
  SELECT *, (full_epochs + CASE WHEN rest > 0 AND sum(tokens) OVER (
             PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
           ) <= rest THEN 1 ELSE 0 END)::INTEGER AS epochs
  FROM keyed
)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epochs FROM taken WHERE epochs > 0
"""


SQL = _sql(Mixture())
