"""Extraction of code from free-form responses: JSON wrapper, fenced block, raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeassay.functions.arrow_udfs import json_answer_udf
from codeassay.functions.text import WS, WS_NO_NEWLINE, has, is_blank, settle, strip
from codeassay.schemas import DEFAULT_FILE_PATH, EMPTY_OUTPUT_ERROR

# Opening fence, a whitespace run holding a newline, then the shortest body up to a closing fence
# at a line start. The run is possessive: what it swallows would be stripped from the body anyway.
_FENCE = rf"(?s)```(?:python)?(?=[{WS_NO_NEWLINE}]*+\n)[{WS}]*+(.*?)\n```"
_CLOSING = "\n```"


def may_be_json(output: Column) -> Column:
    """Whether the JSON form is possible at all: a whole-text object, or both keys in the text."""
    whole = F.startswith(F.ltrim(output, F.lit(" \t\r\n")), F.lit("{"))
    return whole | (has(output, '"file_path"') & has(output, '"content"'))


def json_answer(output: Column) -> Column:
    """struct<content, file_path>, or null. Ungated rows send only a null to Python."""
    return json_answer_udf(F.when(may_be_json(output) & ~is_blank(output), output))


def json_answers(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``content`` and ``file_path`` of JSON-wrapped answers; null for all others."""
    parsed = df.withColumn("_json", json_answer(F.col(output)))
    fields = {f: F.col(f"_json.{f}") for f in ("content", "file_path")}
    return settle(parsed, fields).drop("_json")


def _fenced_body(output: Column) -> Column:
    """Stripped body of the first fenced block; empty or null when there is none.

    The search text ends at the last closing fence, so every valid opening fence has its closing
    fence ahead and no search runs to the end of the text in vain. A matched body is never blank.
    """
    tail = F.substring_index(output, _CLOSING, -1)
    head = F.left(output, F.length(output) - F.length(tail))
    return F.when(has(output, _CLOSING), strip(F.regexp_extract(head, _FENCE, 1)))


def fenced(df: DataFrame, output: str = "output", out: str = "content") -> DataFrame:
    """Add the body of the first fenced block, or null."""
    return settle(df, {out: _fenced_body(F.col(output))}).withColumn(out, F.nullif(out, F.lit("")))


def extract(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``success, format, content, file_path, extraction_error``.

    Order: JSON, fenced, raw. A null or blank output fails with empty content.
    """
    text = F.col(output)
    first = df.withColumn("_json", json_answer(text)).withColumn("_blank", is_blank(text))
    answered, blank = F.col("_json").isNotNull(), F.col("_blank")
    # evaluated only where nothing cheaper has decided
    second = first.withColumn("_fenced", F.when(~blank & ~answered, _fenced_body(text)))
    boxed = F.coalesce(F.col("_fenced"), F.lit("")) != ""
    return settle(
        second,
        {
            "success": ~blank,
            "format": F.when(answered, F.lit("json_wrapped"))
            .when(boxed, F.lit("markdown_wrapped"))
            .otherwise(F.lit("raw_code")),
            "content": F.when(blank, F.lit(""))
            .when(answered, F.col("_json.content"))
            .when(boxed, F.col("_fenced"))
            .otherwise(strip(text)),
            "file_path": F.coalesce(F.col("_json.file_path"), F.lit(DEFAULT_FILE_PATH)),
            "extraction_error": F.when(blank, F.lit(EMPTY_OUTPUT_ERROR)),
        },
    ).drop("_json", "_blank", "_fenced")


def format_mix(responses: DataFrame) -> DataFrame:
    """Detected formats and parse failures per model, with each format's share of the model."""
    counts = (
        extract(responses)
        .groupBy("model", "format")
        .agg(
            F.count(F.lit(1)).alias("responses"),
            F.count_if(~F.col("success")).alias("parse_failures"),
        )
    )
    # at most three rows per model here
    per_model = F.sum("responses").over(Window.partitionBy("model"))
    return counts.withColumn("share", F.round(F.col("responses") / per_model, 6))
