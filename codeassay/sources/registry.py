"""The ordered registry of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeassay.schemas import REGISTERED_MODELS


def registered_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REGISTERED_MODELS)), "ordinal int, name string")


def with_models(rows: DataFrame, model: str = "model") -> DataFrame:
    """The registry in front of ``rows``: every registered model with its rows, those without any included."""
    spark = rows.sparkSession
    return registered_models(spark).join(rows, F.col("name") == F.col(model), "left").drop(model)
