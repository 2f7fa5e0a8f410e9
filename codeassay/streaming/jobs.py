"""Latest status per job, over a table or a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeassay.session import hadoop_path


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per job by (ts, event_id).

    The ordering key is part of the aggregate, so a late event never replaces a newer one, and the
    same expression serves batch and ``update``-mode streaming with one row of state per job.
    """
    newest = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("job_id").agg(newest.alias("_n"), F.count(F.lit(1)).alias("transitions")).select(
        "job_id", F.col("_n.status").alias("status"), F.col("_n.ts").alias("updated_at"), "transitions"
    )


def start_status_stream(events: DataFrame, sink: str, checkpoint: str):
    """Keep a table of status changes; each batch appends the jobs it changed, under its epoch."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return (
        latest_status(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_status(changes: DataFrame) -> DataFrame:
    """The table of current statuses from a change table written by ``start_status_stream``."""
    newest = F.max(F.struct("epoch", "status", "updated_at", "transitions"))
    return changes.groupBy("job_id").agg(newest.alias("_n")).select(
        "job_id", "_n.status", "_n.updated_at", "_n.transitions"
    )


# ---------------------------------------------------------------------------
# A keyed table of statuses that stays small: a base and the changes since
# ---------------------------------------------------------------------------

#: Jobs that are over; only these can expire.
ENDED = ("completed", "failed")


def _changes(events: DataFrame) -> DataFrame:
    """Newest event and number of events per job, in a form that merges with others of its kind."""
    return events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("newest"), F.count(F.lit(1)).alias("transitions"))


def _merged(changes: DataFrame) -> DataFrame:
    return changes.groupBy("job_id").agg(F.max("newest").alias("newest"), F.sum("transitions").alias("transitions"))


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Epochs whose folders are complete, in order."""
    fs, root = hadoop_path(spark, folder)
    if not fs.exists(root):
        return []
    paths = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("epoch=")]
    return sorted(int(p.getName().split("=")[1]) for p in paths if fs.exists(p.suffix("/_SUCCESS")))


def _parts(spark: SparkSession, table: str) -> tuple[int | None, list[int]]:
    """The newest base, and the epochs of changes that it doesn't have."""
    bases = _epochs(spark, f"{table}/base")
    base = bases[-1] if bases else None
    return base, [e for e in _epochs(spark, f"{table}/changes") if base is None or e > base]


def _all_changes(spark: SparkSession, table: str) -> DataFrame | None:
    base, later = _parts(spark, table)
    folders = [f"{table}/changes/epoch={e}" for e in later] + ([] if base is None else [f"{table}/base/epoch={base}"])
    return spark.read.parquet(*folders) if folders else None


def compact(spark: SparkSession, table: str, epoch: int, keep: str | None = None) -> None:
    """Merge the base and all changes into a new base, then remove what it replaces.

    The new base counts as soon as it is complete; whatever an interrupted run leaves behind is older and
    not read. ``keep`` is an interval such as '30 days': ended jobs older than that, seen from the newest event,
    leave the table.
    """
    merged = _merged(_all_changes(spark, table))
    if keep is not None:
        newest = merged.agg(F.max("newest.ts").alias("t")).first()["t"]
        ended = F.col("newest.status").isin(*ENDED) & (F.col("newest.ts") < F.lit(newest) - F.expr(f"INTERVAL {keep}"))
        merged = merged.filter(~ended)
    merged.write.mode("overwrite").parquet(f"{table}/base/epoch={epoch}")
    for kind in ("base", "changes"):
        for old in _epochs(spark, f"{table}/{kind}"):
            if old < epoch or kind == "changes":
                fs, path = hadoop_path(spark, f"{table}/{kind}/epoch={old}")
                fs.delete(path, True)


def start_status_table(events: DataFrame, table: str, checkpoint: str, compact_every: int = 16, keep: str | None = None):
    """Keep a table of statuses from a stream: no state between batches, at most ``compact_every`` folders of changes.

    Each batch writes the jobs it saw, under its epoch, so a batch that runs again replaces itself. An epoch that
    a base has already is not written again. The table belongs to its checkpoint: epochs count from there.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base, _ = _parts(spark, table)
        if base is not None and epoch <= base:
            return
        _changes(batch).write.mode("overwrite").parquet(f"{table}/changes/epoch={epoch}")
        if len(_epochs(spark, f"{table}/changes")) >= compact_every:
            compact(spark, table, epoch, keep)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_status_table(spark: SparkSession, table: str) -> DataFrame:
    """job_id, status, updated_at, transitions: the current statuses. Late events never win over newer ones."""
    merged = _merged(_all_changes(spark, table))
    return merged.select("job_id", F.col("newest.status").alias("status"), F.col("newest.ts").alias("updated_at"), "transitions")
