"""Append-only parquet tables and the document sink.

A table is a folder of ``batch_id=<n>`` partitions. A batch is written by
overwriting its own partition only, so a batch that is run again after a lost
executor or a failed job replaces itself and never doubles rows. Readers fold
the batches: first complete row per key, or highest ``seq`` per key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.session import shared_folder


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def read_table(
    spark: SparkSession, path: str, schema: str, before_batch: int | None = None
) -> DataFrame:
    """All batches, or those before ``before_batch``; empty if none exist."""
    try:
        rows = spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        rows = spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    if before_batch is not None:
        # a partition column: other batches are never opened
        rows = rows.where(F.col("batch_id") < before_batch)
    return rows


def materialized(rows: DataFrame, purpose: str) -> DataFrame:
    """The same rows, computed now and read back from the shared folder."""
    spark = rows.sparkSession
    folder = shared_folder(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def write_artifacts(files: DataFrame, path: str) -> None:
    """Write prepared documents, a folder per document kind.

    Rows keep their ids as columns: a folder per job would mean as many
    folders as jobs. :func:`write_artifact_folders` gives that layout.
    """
    files.write.mode("overwrite").partitionBy("file_name").parquet(path)


def write_artifact_folders(files: DataFrame, path: str) -> None:
    """A folder per candidate, job and document with the bare text in it, for
    consumers that want files. There is one row per folder, so the rows of a
    sought-after job still spread over all tasks."""
    keys = ["candidate_id", "job_id", "file_name"]
    (
        files.select(*keys, F.col("content").alias("value"))
        .repartition(*keys)
        .write.mode("overwrite")
        .partitionBy(*keys)
        .text(path)
    )
