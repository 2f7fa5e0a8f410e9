"""How each attempt changed the code: carried-forward content, sizes, hashes and line diffs.

An attempt with content replaces the file; an empty one leaves it as it was; the next attempt sees
the last version written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeassay.functions.arrow_udfs import diff_stats_udf
from codeassay.functions.text import is_blank, read_back, settle
from codeassay.operators.extract import extract
from codeassay.operators.skew import block_of, carry_forward, spans_blocks

KEY = ["run_id", "iteration"]

TEXT_BLOCK = 64

# Fixed texts.
NO_TARGET, NO_CONTENT = "Target file not found", "Parsed output content is empty"


def with_content(attempts: DataFrame) -> DataFrame:
    """Add the extracted ``content`` of each attempt; null when the attempt wrote nothing."""
    kept = extract(attempts).withColumn("content", F.when(F.col("success"), F.col("content")))
    return kept.select(*attempts.columns, "content", "format")


def carried_content(
    attempts: DataFrame, template: Column | str, block: int = TEXT_BLOCK
) -> DataFrame:
    """Per attempt, the file text before it (``content_before``) and its own new ``content``.

    Texts are extracted and shuffled once. The window that carries them sees at most ``block``
    attempts of a run, more than retry loops make. Should a run be longer, which is found when the query runs, its
    later blocks get the number of the attempt to inherit from, and fetch that attempt's text.
    """
    start = read_back(F.lit(template) if isinstance(template, str) else template)
    before = (
        Window.partitionBy("run_id", "_block").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        with_content(attempts)
        .withColumn("_block", block_of("iteration", block))
        .withColumn("_near", F.last(read_back(F.col("content")), ignorenulls=True).over(before))
    )
    return (
        carried.join(_inherited_texts(attempts, block), ["run_id", "_block"], "left")
        .withColumn("content_before", F.coalesce("_near", "_text", start))
        .drop("_block", "_near", "_text")
    )


def _inherited_texts(attempts: DataFrame, block: int) -> DataFrame:
    """Per later block of a long run, the text written last before it: (run_id, _block, _text)."""
    spans = spans_blocks(attempts, "iteration", block)
    marks = attempts.filter(spans).select(*KEY, F.when(~is_blank(F.col("output")), F.col("iteration")).alias("_wrote"))
    sources = (
        carry_forward(marks, "run_id", "iteration", "_wrote", "_source")
        .withColumn("_block", block_of("iteration", block))
        .groupBy("run_id", "_block")
        .agg(F.min_by("_source", "iteration").alias("_source"))
        .filter("_source is not null and _block > 0")
    )
    texts = with_content(attempts.filter(spans)).select(
        "run_id", F.col("iteration").alias("_source"), read_back(F.col("content")).alias("_text")
    )
    return sources.join(texts, ["run_id", "_source"]).select("run_id", "_block", "_text")


def patch_size(attempts: DataFrame, template: Column | str) -> DataFrame:
    """``bytes_changed`` (difference in characters), hashes before and after, and patch success.

    A null template stands for a missing target file: no patch applies. Only lengths and hashes are carried forward, so no text leaves the scan.
    """
    start = read_back(F.lit(template) if isinstance(template, str) else template)
    content = F.col("content")
    disk = read_back(content)
    sizes = with_content(attempts).select(
        *KEY,
        F.length(content).alias("_chars"),
        F.sha2(content, 256).alias("modified_hash"),
        F.when(content.isNotNull(), F.struct(F.length(disk).alias("n"), F.sha2(disk, 256).alias("h"))).alias("_own"),
        F.length(start).alias("_start_chars"),
        F.sha2(start, 256).alias("_start_hash"),
    )
    exists, writes = F.col("_start_chars").isNotNull(), F.col("_own").isNotNull()
    patched = exists & writes
    old_chars = F.coalesce(F.col("_old.n"), F.col("_start_chars"))
    return carry_forward(sizes, "run_id", "iteration", "_own", "_old", census=attempts).select(
        *KEY,
        patched.alias("patch_applied"),
        F.when(~exists, F.lit(NO_TARGET)).when(~writes, F.lit(NO_CONTENT)).alias("patch_error"),
        F.when(patched, F.abs(F.col("_chars") - old_chars)).otherwise(F.lit(0)).alias("bytes_changed"),
        F.when(exists, F.coalesce(F.col("_old.h"), F.col("_start_hash"))).otherwise(F.lit("")).alias("original_hash"),
        F.when(patched, F.col("modified_hash")).otherwise(F.lit("")).alias("modified_hash"),
    )


def diff_measures(pairs: DataFrame, old: str = "content_before", new: str = "content") -> DataFrame:
    """Add the line-diff measures of ``old -> new``. Null new content (no patch) measures as zero.

    Equal texts are settled natively; only real changes go to the matcher.
    """
    before, after = F.col(old), F.col(new)
    changed = after.isNotNull() & (before != after)
    measured = pairs.withColumn("_d", diff_stats_udf(F.when(changed, before), F.when(changed, after)))
    names = ("lines_changed", "lines_added", "lines_deleted", "diff_lines")
    return settle(measured, {n: F.coalesce(F.col(f"_d.{n}"), F.lit(0)).cast("int") for n in names}).drop("_d")
