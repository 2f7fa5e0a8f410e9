"""A training-data pipeline: each stage reads what its predecessor kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``. A stage's
rows are written as Parquet and read again as the next one's ``docs``, so a lost executor costs no
more than a part of one stage.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import codeassay
from codeassay.llm import decontaminate, host_rules, mixing, partenum, token_files
from codeassay.llm.common import stable, table

# Functions travel by value, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(codeassay)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, as their host's record lets them count.

    Null and empty texts have no words and go; rows without a source are one host; repeated rows are judged each.
    """
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a Jaccard similarity of 0.8 on five-word shingles.

    The smallest id stays, a null id counting as the largest, then the smallest digest of the text; of equal rows
    one. Texts without words are linked with nothing and stay, once for each id.
    """
    return partenum.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly such words go.

    Others, null and empty texts among them, stay byte for byte; items without words have no passages.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mixture: documents as often as the epochs their source is read for.

    Null languages and sources count as empty ones, null texts as one token; equal rows are taken together.
    """
    return mixing.take_mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32.

    A null text is its end id alone; rows without an id come last; repeated rows are written each.
    """
    return token_files.read_segments(token_files.write_segments(docs, token_files.default_tokenizer()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: The join's components and the tokenizer are beyond SQL; the tests hold a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
