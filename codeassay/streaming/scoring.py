"""Incremental response scoring: the batch functions over a stream of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeassay.operators.batch import without_errors
from codeassay.operators.extract import extract
from codeassay.operators.scoring import compliance_score, failure_modes, quick_scores


def score_responses(responses: DataFrame) -> DataFrame:
    """Stateless scoring of each response; the same for a table and a stream."""
    scored = failure_modes(quick_scores(without_errors(responses)))
    wide = compliance_score(
        extract(scored).withColumn("content", F.when(F.col("success"), F.col("content")))
    )
    return wide.select(
        "response_id", "model", "run", "format", "score", "is_compliant", "compliance_score", "failure_modes"
    )


def start_scoring_stream(responses: DataFrame, sink: str, checkpoint: str):
    """Append scores of new responses to a Parquet sink; exactly once by the sink's own log."""
    return (
        score_responses(responses)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
