"""Ingest and status folding over new files only.

Both queries run with ``trigger(availableNow=True)``: they process what has
arrived since the last run and stop. Progress lives in the checkpoint folder,
results in bucket tables, so a run that is repeated or restarted adds nothing
twice, and a batch opens only the segments that its keys may lie in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators.ingest import ingest_postings
from placewright.sources.buckets import BucketTable
from placewright.sources.tables import write_batch


def run_available(stream_writer) -> None:
    query = stream_writer.trigger(availableNow=True).start()
    query.awaitTermination()


def posting_table(spark: SparkSession, path: str, schema: str) -> BucketTable:
    return BucketTable(spark, path, schema)


def incremental_ingest(
    stream: DataFrame,
    table: str,
    rejects: str,
    checkpoint: str,
    schema: str,
    order: Sequence[Column],
) -> None:
    """Append new postings of a stream, first complete row per key wins.

    ``table`` is the place of a :func:`posting_table`. What it has of the arriving keys is
    found by key sketches: batches without any of them are not opened.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read for its keys, its new rows and its rejects
        try:
            stored = posting_table(batch.sparkSession, table, schema)
            keys = batch.select("job_id").where("job_id IS NOT NULL").distinct()
            known = stored.lookup(keys, before=2 * batch_id).select("job_id")
            result = ingest_postings(known, batch, order)
            write_batch(result.rejected, rejects, batch_id)
            stored.append(result.inserted, batch_id)
            # keys are unique, so segments are only put together
            stored.compact(batch_id, lambda rows: rows)
        finally:
            batch.unpersist()

    run_available(
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    )


STATUS_TABLE = (
    "candidate_id BIGINT, job_id STRING, seq BIGINT, status STRING, notes STRING"
)
STATUS_KEY = ("candidate_id", "job_id")


def status_table(spark: SparkSession, path: str) -> BucketTable:
    return BucketTable(spark, path, STATUS_TABLE, STATUS_KEY)


def _newest(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(*STATUS_KEY)
        .agg(F.max_by(F.struct("seq", "status", "notes"), "seq").alias("last"))
        .select(*STATUS_KEY, "last.*")
    )


def incremental_status(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Keep the latest status per (candidate, job).

    The fold is a streaming aggregate, so its state holds one row per key.
    In update mode every batch emits the keys that changed; they are merged into the
    buckets they belong to, so the newest version of ``table`` has one row per key.
    """
    latest = stream.groupBy(*STATUS_KEY).agg(
        F.max_by(F.struct("seq", "status", "notes"), "seq").alias("last")
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        stored = status_table(batch.sparkSession, table)
        stored.merge(batch.select(*STATUS_KEY, "last.*"), batch_id, _newest)

    run_available(
        latest.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
    )


def current_status(spark: SparkSession, table: str) -> DataFrame:
    """One row per key, read from one version of the table."""
    return status_table(spark, table).read()
