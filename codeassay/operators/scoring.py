"""Compliance features and scores of extracted code; quick scores and issues of raw responses."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from codeassay.functions.checks import feature_columns
from codeassay.functions.modes import (
    mode_flags,
    modes_array,
    quick_facts,
    quick_is_compliant,
    quick_issues,
    quick_score,
)
from codeassay.functions.text import read_back, settle
from codeassay.operators.skew import lookup_join
from codeassay.schemas import DEFAULT_RULES, SIGNATURE

MAX_SCORE = 10


def features(df: DataFrame, content: str = "content", signature: Column | str = SIGNATURE) -> DataFrame:
    """Add one boolean column per compliance check, each text scanned in one projection."""
    on_disk = df.withColumn("_on_disk", read_back(F.col(content)))
    return settle(on_disk, feature_columns(F.col("_on_disk"), signature)).drop("_on_disk")


def _given_rule(rule: str) -> tuple[Column, Column]:
    """Weight and check text that a task's ``scoring_rules`` map leaves for one rule.

    An absent or empty map means the default rules; a rule missing from a map keeps its default
    weight, as does a rule without a weight.
    """
    kind, weight, check_for = DEFAULT_RULES[rule]
    own = F.try_element_at(F.col("scoring_rules"), F.lit(rule))
    own_weight = own["penalty_if_violated"] if kind == "penalty" else own["points"]
    return F.coalesce(own_weight, F.lit(weight)).cast("int"), F.coalesce(own["check_for"], F.lit(check_for))


def effective_rules(task_specs: DataFrame) -> DataFrame:
    """One row per task and rule. The eight defaults are literals, so no join is needed."""
    rows = []
    for rule, (kind, *_) in DEFAULT_RULES.items():
        weight, check_for = _given_rule(rule)
        rows.append(
            F.struct(
                F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), weight.alias("weight"), check_for.alias("check_for")
            )
        )
    return task_specs.select("task_id", F.inline(F.array(*rows)))


def rule_weights(task_specs: DataFrame, *further: Column) -> DataFrame:
    """One row per task, in place: its signature text and eight weight columns ``w_<rule>``."""
    _, signature = _given_rule("signature_compliance")
    return task_specs.select(
        "task_id", *further, signature.alias("signature"), *[_given_rule(r)[0].alias(f"w_{r}") for r in DEFAULT_RULES]
    )


def attach_rules(
    df: DataFrame, rules: DataFrame | None, spread: list[str] | None = None
) -> tuple[DataFrame, Column, dict[str, Column]]:
    """The frame with its rule row joined (if any), the signature to look for, and the rule weights.

    Default weights are literals and need no join. Otherwise the rule row of each task travels to
    the texts, not the texts to the rules.
    """
    if rules is None:
        return df, F.lit(SIGNATURE), {r: F.lit(w) for r, (_, w, _) in DEFAULT_RULES.items()}
    weights = {r: F.coalesce(f"w_{r}", F.lit(w)) for r, (_, w, _) in DEFAULT_RULES.items()}
    joined = lookup_join(df, rules, "task_id", "left", spread)
    return joined, F.coalesce("signature", F.lit(SIGNATURE)), weights


def raw_score(found: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Unclamped score from the feature columns."""
    def effect(rule: str, kind: str) -> Column:
        applies = ~found[rule] if kind == "penalty" else found[rule]
        return F.when(applies, weights[rule]).otherwise(F.lit(0))

    return F.lit(MAX_SCORE) + reduce(add, [effect(r, kind) for r, (kind, *_) in DEFAULT_RULES.items()])


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_SCORE), score)).cast("int")


def content_score(content: Column, signature: Column, weights: dict[str, Column]) -> Column:
    """Clamped compliance score of one text as a single expression; null content scores 0."""
    total = raw_score(feature_columns(read_back(content), signature), weights)
    return F.when(content.isNull(), F.lit(0)).otherwise(clamp(total)).cast("int")


def compliance_score(
    df: DataFrame,
    content: str = "content",
    rules: DataFrame | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Add the eight features, ``raw_score`` and ``compliance_score`` (clamped to 0..10).

    ``rules`` comes from ``rule_weights``; ``spread`` names columns that tell the rows of a task
    apart. Null content scores 0.
    """
    joined, signature, weights = attach_rules(df, rules, spread)
    total = raw_score({r: F.col(r) for r in DEFAULT_RULES}, weights)
    return (
        features(joined, content, signature)
        .withColumn("raw_score", F.when(F.col(content).isNull(), F.lit(0)).otherwise(total).cast("int"))
        .withColumn("compliance_score", clamp(F.col("raw_score")))
        .select(*df.columns, *DEFAULT_RULES, "raw_score", "compliance_score")
    )


def failure_modes(df: DataFrame, output: str = "output") -> DataFrame:
    return df.withColumn("failure_modes", modes_array(mode_flags(F.col(output))))


def quick_scores(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``score, max_score, normalized, is_compliant, compliance_issues`` of the raw output.

    Empty or null output scores 0, is not compliant and has one issue.
    """
    names = quick_facts(F.col(output))
    with_facts = df.withColumns({f"_{n}": c for n, c in names.items()})
    facts = {n: F.col(f"_{n}") for n in names}
    return (
        with_facts.withColumns(
            {
                "score": quick_score(facts),
                "max_score": F.lit(MAX_SCORE),
                "is_compliant": quick_is_compliant(facts),
                "compliance_issues": quick_issues(facts),
            }
        )
        .withColumn("normalized", F.col("score") / F.lit(float(MAX_SCORE)))
        .drop(*[f"_{n}" for n in names])
    )


def token_estimate(prompt: Column, response: Column) -> Column:
    """About four characters per token; code points, integer division."""
    chars = F.coalesce(F.length(prompt), F.lit(0)) + F.coalesce(F.length(response), F.lit(0))
    return F.shiftright(chars, 2)


def passes_threshold(df: DataFrame, threshold: int = 7) -> DataFrame:
    """Rows at or above the threshold that break no hard constraint. Expects ``compliance_score``."""
    hard = [F.col(rule) for rule, (kind, *_) in DEFAULT_RULES.items() if kind == "penalty"]
    return df.filter((F.col("compliance_score") >= threshold) & hard[0] & hard[1] & hard[2])
