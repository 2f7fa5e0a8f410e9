"""Exact dedup by a tree merge of sorted digest runs.

Every task turns its rows into runs: digests in order, each with the smallest row that has it and the
number of rows. Runs are merged in binomial rounds. In each round the runs of ``2**BITS`` neighbours
are exchanged by digest and merged, so a key never meets more than ``2**BITS`` entries, whatever the size
of its group, and the last run, of all rows, lies spread over as many tasks as the first ones. What
the merged runs say of digests with more than one row then goes down the same tree, run by run, to the rows.

Only DataFrame functions are used. Aggregates over structs sort their input by the key and merge it as a
stream, on either side of an exchange: these are the sorted runs and their multiway merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeassay.llm.common import discard, order_id, stable, table

#: Runs that one round merges into one: 2**BITS.
BITS = 4
#: A task's rows are cut into runs of so many rows (a power of two).
RUN_BITS = 16
#: What is compared: a digest with length and a second hash, which verify it.
KEY = ("digest", "n_bytes", "check")


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, id, row, part, run, digest, n_bytes, check) of every row, as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("id"), normalised().alias("text"))
    signed = rows.select(
        "doc_id",
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stable(
        signed.withColumn("part", F.shiftright("row", 33)).withColumn(
            "run", F.shiftright(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), RUN_BITS)
        )
    )


def _merged(runs: DataFrame, *node: Column) -> DataFrame:
    """One entry per node of the tree and digest: its smallest row and its number of rows."""
    return runs.groupBy(*node, *KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def merge_levels(rows: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The runs of each level, as written tables; those of the last level belong to all rows.

    Level 0 has the runs of (part, run), level 1 those of a part, level k those of ``part >> (k - 1) * bits``.
    """
    least = F.struct("id", "row", "doc_id").alias("least")
    first = rows.select("part", "run", *KEY, least, F.lit(1).cast("long").alias("n"))
    levels = [stable(_merged(first, F.col("part"), F.col("run")))]
    levels.append(stable(_merged(levels[0], F.col("part"))))
    last = rows.agg(F.max("part")).first()[0] or 0
    while last:
        last >>= bits
        levels.append(stable(_merged(levels[-1], F.shiftright("part", bits).alias("part"))))
    return levels


def verdicts(levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """(part, run, digest, n_bytes, check, keep, group_size) of each first run's entries that have copies.

    From the last level down: an entry of a run asks the run it was merged into, which has one entry for it.
    """
    answers = levels[-1].filter("n > 1").select("part", *KEY, F.col("least").alias("keep"), F.col("n").alias("group_size"))
    for depth in range(len(levels) - 2, -1, -1):
        parent = F.shiftright("part", bits) if depth else F.col("part")
        entries = levels[depth].drop("least", "n").withColumn("parent", parent)
        answers = entries.join(answers.withColumnRenamed("part", "parent"), ["parent", *KEY]).drop("parent")
    return answers


def dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; further columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; a null id counts as the largest, and of rows
    with the same id one stays. A null text counts as empty. Texts are taken as equal if SHA-256, length and a
    second hash of the normalised texts are. An empty table gives no rows.
    """
    rows = digest_rows(docs)
    levels = merge_levels(rows, bits)
    found = stable(verdicts(levels, bits))
    discard(*levels)
    return rows.join(found, ["part", "run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
"""
