"""The views carry the whole texts of the tables they are made from."""

import pytest
from pyspark.sql import functions as F

from codeassay.operators import diffs, extract
from codeassay.plans import corpus

SF = "/root/testdata/sf0.001"
BLANK_VARIANTS = (5, 10, 11)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("response_id"), "text")


def plain(column):
    """Without the marks of comments and escapes, so that texts compare."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(column, r"\\n", "\n"), r"\\(.)", "$1"), r"(?m)^# ?", "")


def test_every_answer_holds_its_text(spark, documents):
    answers = corpus.responses(spark, SF).filter(F.col("error").isNull() & ~F.col("variant").isin(*BLANK_VARIANTS))
    lost = answers.join(documents, "response_id").filter(~F.contains(plain(F.col("output")), plain(F.col("text"))))
    assert lost.count() == 0 and answers.count() > 0.7 * documents.count()


def test_extracted_code_holds_most_texts(spark, documents):
    """In code shapes the text survives extraction; only prose around a fence is left behind."""
    code = extract.extract(corpus.responses(spark, SF)).filter("success AND variant NOT IN (0, 7, 11, 12)")
    lost = code.join(documents, "response_id").filter(F.length("content") < F.length(F.trim("text")))
    assert lost.count() == 0


def test_every_written_attempt_holds_its_turn(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'assistant'")
    total = turns.agg(F.sum(F.length("text"))).first()[0]
    written = diffs.with_content(corpus.attempts(spark, SF)).filter("content is not null")
    chars = written.agg(F.sum(F.length("content"))).first()[0]
    assert 0.6 * total < chars


def test_prompts_hold_the_texts(spark, documents):
    rows = corpus.prompted(spark, SF).join(documents, "response_id")
    assert rows.filter(~F.endswith("prompt", "text")).count() == 0
