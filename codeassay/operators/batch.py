"""Batch statistics over scored responses.

Every statistic is one aggregation with bounded buffers and map-side combination, so a model or
mode holding any share of the rows costs each task one partial row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from codeassay.functions.modes import mode_flags
from codeassay.operators.scoring import failure_modes, quick_scores
from codeassay.schemas import FAILURE_CATEGORIES, FAILURE_MODES, NO_FAILURE, REGISTERED_MODELS


def evaluation_grid(spark: SparkSession, n_runs: int, models: Sequence[str] = REGISTERED_MODELS) -> DataFrame:
    """Run-major grid of runs and models, from arithmetic on a range."""
    names = F.array(*[F.lit(m) for m in models])
    cell = F.col("id")
    return spark.range(n_runs * len(models)).select(
        (F.floor(cell / len(models)) + 1).cast("int").alias("run"),
        F.element_at(names, (cell % len(models) + 1).cast("int")).alias("model"),
    )


def missing_cells(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """Grid cells without a usable response. Responses shrink to their cells before they move."""
    done = without_errors(responses).groupBy("run", "model").agg(F.lit(True).alias("done"))
    return grid.join(done, ["run", "model"], "left_anti")


#: Runs that one bitmap tells of: the 4096 bytes of ``bitmap_construct_agg``.
SLICE = 4096 * 8


def unseen_cells(responses: DataFrame, n_runs: int, models: Sequence[str] = REGISTERED_MODELS) -> DataFrame:
    """Cells of the grid of runs 1 to ``n_runs`` and models that have no usable response.

    Responses become one bitmap for each model and slice of runs, combined map-side. Only slices travel; a slice
    without gaps is dropped whole, and of the others only bytes with a gap are looked into.
    """
    names = F.array(*[F.lit(m) for m in models])
    usable = without_errors(responses).filter(F.col("model").isin(*models) & F.col("run").between(1, n_runs))
    run = F.col("run").cast("long")
    seen = usable.groupBy("model", F.bitmap_bucket_number(run).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(run)).alias("bits"))
    cell, slices = F.col("id"), -(-n_runs // SLICE)
    grid = responses.sparkSession.range(slices * len(models)).select(
        F.element_at(names, (cell % len(models) + 1).cast("int")).alias("model"), (F.floor(cell / len(models)) + 1).alias("slice")
    )
    # runs of the slice, the last one being shorter
    width = F.least(F.lit(SLICE), F.lit(n_runs) - (F.col("slice") - 1) * SLICE).cast("int")
    gaps = """flatten(transform(filter(sequence(0, (width - 1) div 8), i -> bits IS NULL OR substring(bits, i + 1, 1) <> X'FF'),
        i -> transform(filter(sequence(0, 7), k -> i * 8 + k < width AND (bits IS NULL OR getbit(cast(conv(hex(substring(bits, i + 1, 1)), 16, 10) AS INT), k) = 0)),
                       k -> i * 8 + k)))"""
    open_slices = grid.join(seen, ["model", "slice"], "left").withColumn("width", width)
    open_slices = open_slices.filter(F.col("bits").isNull() | (F.bitmap_count("bits") < F.col("width")))
    at = open_slices.select("model", "slice", F.explode(F.expr(gaps)).alias("at"))
    return at.select(((F.col("slice") - 1) * SLICE + F.col("at") + 1).cast("int").alias("run"), "model")


def without_errors(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("error").isNull())


def scored_batch(responses: DataFrame) -> DataFrame:
    """Per-response batch rows, errors excluded; the response text is dropped."""
    scored = failure_modes(quick_scores(without_errors(responses)))
    return scored.select(
        "response_id",
        "run",
        "model",
        "score",
        "normalized",
        "is_compliant",
        "latency_ms",
        "failure_modes",
        "compliance_issues",
    )


def _percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part * 100.0 / total, 6)).otherwise(F.lit(0.0))


def compliance_rate(scored: DataFrame) -> DataFrame:
    total, compliant = F.col("total_runs"), F.col("compliant")
    return (
        scored.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if("is_compliant").alias("compliant"))
        .withColumn("compliant_rate", _percent(compliant, total))
        .withColumn("non_compliant", total - compliant)
        .withColumn("non_compliant_rate", F.round(F.lit(100.0) - F.col("compliant_rate"), 6))
    )


def score_distribution(scored: DataFrame) -> DataFrame:
    """Mean, upper median, min, max and population deviation per model.

    The discrete median of the descending order is the upper median. Its buffer counts distinct
    scores, of which there are eleven at most.
    """
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.expr("percentile_disc(0.5) within group (order by score desc)").cast("int").alias("median_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.round(F.stddev_pop("score"), 6).alias("stddev_score"),
    )


def mode_totals(responses: DataFrame, output: str = "output") -> DataFrame:
    """One row: ``total`` and one count per failure mode, sentinel included.

    Counting flags directly keeps the scan in one codegen stage: no array per row and no explode,
    and each task hands over a single row.
    """
    flags = mode_flags(F.col(output))
    named = responses.select(*[flag.alias(mode) for mode, flag in flags.items()])
    clean = F.lit(True)
    for mode in FAILURE_MODES:
        clean = clean & ~F.col(mode)
    return named.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(mode)).alias(mode) for mode in FAILURE_MODES],
        F.count_if(clean).alias(NO_FAILURE),
    )


def failure_mode_distribution(responses: DataFrame) -> DataFrame:
    """Occurrences and share of responses per mode seen, most frequent first."""
    totals = mode_totals(without_errors(responses))
    rows = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), F.col(mode).alias("occurrences"))
            for mode in (*FAILURE_MODES, NO_FAILURE)
        ]
    )
    return (
        totals.select("total", F.inline(rows))
        .filter("occurrences > 0")
        .select("mode", "occurrences", _percent(F.col("occurrences"), F.col("total")).alias("percent"))
        .orderBy(F.desc("occurrences"), "mode")
    )


def failure_category_rollup(responses: DataFrame) -> DataFrame:
    """Failures per category; empty categories stay and the sentinel belongs to none."""
    totals = mode_totals(without_errors(responses))
    sums = [sum((F.col(m) for m in modes), F.lit(0)) for modes in FAILURE_CATEGORIES.values()]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("category"), count.cast("long").alias("failures"))
            for name, count in zip(FAILURE_CATEGORIES, sums)
        ]
    )
    return totals.select(F.inline(rows))


def _summary_totals(flags: dict[str, Column]) -> list[Column]:
    """Aggregates of a summary over rows with score and is_compliant; ``flags`` tells of each failure mode."""
    clean = F.lit(True)
    for mode in FAILURE_MODES:
        clean = clean & ~flags[mode]
    return [
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("is_compliant").alias("_compliant"),
        F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean_score"),
        *[F.count_if(flags[mode]).alias(mode) for mode in FAILURE_MODES],
        F.count_if(clean).alias(NO_FAILURE),
    ]


def _summary(totals: DataFrame, models: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(m).alias("key"), F.col(m).alias("value")) for m in (*FAILURE_MODES, NO_FAILURE)]
    )
    return totals.select(
        "total_runs",
        _percent(F.col("_compliant"), F.col("total_runs")).alias("compliant_rate"),
        F.array(*[F.lit(m) for m in models]).alias("registered_models"),
        "mean_score",
        F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)).alias("failure_modes"),
    )


def batch_summary(responses: DataFrame, models: Sequence[str] = REGISTERED_MODELS) -> DataFrame:
    """One summary row; ``failure_modes`` maps the modes seen to their counts."""
    kept = without_errors(responses)
    flags = mode_flags(F.col("output"))
    rows = quick_scores(kept).select(
        "score", "is_compliant", *[flag.alias(mode) for mode, flag in flags.items()]
    )
    return _summary(rows.agg(*_summary_totals({mode: F.col(mode) for mode in FAILURE_MODES})), models)


def observed_batch(scored: DataFrame) -> tuple[DataFrame, Observation]:
    """``scored_batch`` rows, and an observation of their summary that whatever action reads them makes."""
    seen = Observation("batch_summary")
    flags = {mode: F.array_contains("failure_modes", mode) for mode in FAILURE_MODES}
    return scored.observe(seen, *_summary_totals(flags)), seen


def observed_summary(spark: SparkSession, seen: Observation, models: Sequence[str] = REGISTERED_MODELS) -> DataFrame:
    """The summary row of an observation whose action has ended."""
    found = seen.get
    counts = [n for n in found if n != "mean_score"]
    totals = spark.createDataFrame(
        [(*[found[n] for n in counts], found["mean_score"])], ", ".join(f"`{n}` long" for n in counts) + ", mean_score double"
    )
    return _summary(totals, models)


def route_models(requests: DataFrame, models: Sequence[str] = REGISTERED_MODELS) -> DataFrame:
    """The preferred model if registered, else round robin on ``index``. The registry is a literal."""
    if not models:
        raise ValueError("No registered models are available")
    names = F.array(*[F.lit(m) for m in models])
    turn = F.element_at(names, (F.pmod(F.col("index"), F.lit(len(models))) + 1).cast("int"))
    return requests.withColumn(
        "model", F.when(F.col("preferred").isin(*models), F.col("preferred")).otherwise(turn)
    )
