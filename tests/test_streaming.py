"""Streams give the batch answers, also when files arrive in several rounds and out of order."""

import datetime
import os
import random

from codeassay.functions.text import has
from codeassay.streaming import jobs, scoring
from codeassay.schemas import RESPONSES

TEXTS = ["", None, "def f(): pass", '{"content": "x = 1"}', "```\nclass A:\n  pass\n```", "def generate_user_report(users): seen sort"]
EVENTS = "event_id long, ts timestamp, job_id long, status string"


def test_scoring_stream_equals_batch(spark, tmp_path):
    source, sink, log = (str(tmp_path / d) for d in ("in", "out", "log"))
    rows = [(i, "t", "m", 1, TEXTS[i % len(TEXTS)], 1.0, "HTTP 500" if i % 9 == 0 else None) for i in range(120)]
    for start in (0, 40, 80):
        spark.createDataFrame(rows[start : start + 40], RESPONSES).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(RESPONSES).parquet(source)
        scoring.start_scoring_stream(arriving, sink, log).awaitTermination()
    batch = scoring.score_responses(spark.createDataFrame(rows, RESPONSES))
    stream = spark.read.parquet(sink).select(*batch.columns)
    assert stream.count() == batch.count() == len([r for r in rows if r[6] is None])
    assert stream.exceptAll(batch).isEmpty()


def test_status_stream_ignores_late_events(spark, tmp_path):
    source, sink, log = (str(tmp_path / d) for d in ("in", "out", "log"))
    rounds = [
        [(1, "2024-01-01 00:00:01", 7, "queued"), (2, "2024-01-01 00:00:09", 7, "completed"), (3, "2024-01-01 00:00:02", 8, "queued")],
        [(4, "2024-01-01 00:00:05", 7, "running"), (5, "2024-01-01 00:00:02", 8, "running")],
    ]
    for events in rounds:
        df = spark.createDataFrame(events, "event_id long, ts string, job_id long, status string")
        df.selectExpr("event_id", "cast(ts as timestamp) as ts", "job_id", "status").write.mode("append").parquet(source)
        jobs.start_status_stream(spark.readStream.schema(EVENTS).parquet(source), f"{sink}/c", log).awaitTermination()
    got = {r.job_id: (r.status, r.transitions) for r in jobs.current_status(spark.read.parquet(f"{sink}/c")).collect()}
    assert got == {7: ("completed", 3), 8: ("running", 2)}
    batch = {r.job_id: (r.status, r.transitions) for r in jobs.latest_status(spark.read.parquet(source)).collect()}
    assert batch == got


def test_has_needs_no_escaping(spark):
    df = spark.createDataFrame([("100%_[x]",), ("100x",)], "t string")
    assert [r.m for r in df.select(has(df.t, "%_[").alias("m")).collect()] == [True, False]


EVENTS = "event_id long, ts timestamp, job_id long, status string"


def _files(spark, folder, n, late=True):
    """n files of events; some events are late, some repeat a time."""
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        part = []
        for j in range(30):
            minutes = r.randrange(max(0, k - 3), k + 1) * 10 if late else k * 10
            part.append((k * 100 + j, start + datetime.timedelta(minutes=minutes), r.randrange(40), r.choice(["queued", "running", "completed", "failed"])))
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        rows += part
    return spark.createDataFrame(rows, EVENTS)


def test_a_status_table_stays_small_over_many_batches(spark, tmp_path):
    events = _files(spark, str(tmp_path / "in"), 30)
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    query = jobs.start_status_table(arriving, table, str(tmp_path / "log"), compact_every=4)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 30
    assert all(not p.stateOperators for p in query.recentProgress)  # nothing is kept between batches
    assert len(os.listdir(f"{table}/base")) == 1 and len(os.listdir(f"{table}/changes")) < 4
    assert jobs.read_status_table(spark, table).exceptAll(jobs.latest_status(events)).isEmpty()
    assert jobs.read_status_table(spark, table).count() == jobs.latest_status(events).count()
    # a late event of one more batch can't win
    late = spark.createDataFrame([(10**6, datetime.datetime(2023, 1, 1), j, "queued") for j in range(40)], EVENTS)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    jobs.start_status_table(arriving, table, str(tmp_path / "log"), compact_every=4).awaitTermination()
    assert jobs.read_status_table(spark, table).exceptAll(jobs.latest_status(events.unionByName(late))).isEmpty()


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    events = _files(spark, str(tmp_path / "in"), 6)
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    for log in ("one", "two"):  # all batches again, as after the loss of the log
        jobs.start_status_table(arriving, table, str(tmp_path / log), compact_every=3).awaitTermination()
    # a base that a stopped run left without its mark is not read
    os.makedirs(f"{table}/base/epoch=99")
    found = jobs.read_status_table(spark, table)
    assert found.exceptAll(jobs.latest_status(events)).isEmpty() and found.count() == jobs.latest_status(events).count()


def test_ended_jobs_expire(spark, tmp_path):
    rows = [(1, datetime.datetime(2024, 1, 1), 1, "completed"), (2, datetime.datetime(2024, 1, 1), 2, "running"), (3, datetime.datetime(2024, 3, 1), 3, "failed")]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    jobs.start_status_table(arriving, table, str(tmp_path / "log"), compact_every=1, keep="30 days").awaitTermination()
    assert {r.job_id for r in jobs.read_status_table(spark, table).collect()} == {2, 3}
