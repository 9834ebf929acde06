"""Keyed folds of decision, status, artifact and message events.

All folds are ``max_by`` aggregates. Spark combines them on the map side, so
what is shuffled is one row per key and task, however many events a key has.
Order within a key comes from ``seq`` (``turn`` for messages), not from the
order of rows in files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright import schemas

PAIR = ("candidate_id", "job_id")


def last_write(
    events: DataFrame, values: Sequence[str], key: Sequence[str] = PAIR, seq: str = "seq"
) -> DataFrame:
    """The whole latest record per key, NULL fields included."""
    last = F.max_by(F.struct(*values), seq)
    return events.groupBy(*key).agg(last.alias("last")).select(*key, "last.*")


def merge_fields(
    events: DataFrame, fields: Sequence[str], key: Sequence[str] = PAIR, seq: str = "seq"
) -> DataFrame:
    """The latest non-NULL value of each field; an empty string is a value."""
    return events.groupBy(*key).agg(
        *[
            F.max_by(field, F.when(F.col(field).isNotNull(), F.col(seq))).alias(field)
            for field in fields
        ]
    )


def merge_artifacts(deltas: DataFrame) -> DataFrame:
    return merge_fields(deltas, schemas.ARTIFACT_FIELDS)


def latest_status(events: DataFrame) -> DataFrame:
    return last_write(events, ["status", "notes"])


def any_pursued(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per candidate: is anything pursued, and which step follows."""
    said = decisions.groupBy("candidate_id").agg(F.bool_or("pursue").alias("pursued"))
    flag = F.coalesce("pursued", F.lit(False))
    return (
        candidates.select("candidate_id")
        .distinct()
        .join(said, "candidate_id", "left")
        .select(
            "candidate_id",
            flag.alias("pursued"),
            F.when(flag, "preparer").otherwise("human_review").alias("next_step"),
        )
    )


def append_messages(channel: DataFrame, turns: DataFrame) -> DataFrame:
    """Message channel after new turns. The next stage starts from the typed
    tables and an empty channel, so nothing is ever removed here."""
    return channel.unionByName(turns)


def thread_summary(messages: DataFrame) -> DataFrame:
    """Text of the last non-empty assistant turn of each thread, or NULL."""
    spoken = (F.col("role") == "assistant") & (F.col("text") != "")
    return messages.groupBy("thread_id").agg(
        F.max_by("text", F.when(spoken, F.col("turn"))).alias("summary")
    )


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Rows per outcome of an extraction run, with the reason of failures."""
    return attempts.groupBy("outcome", "reason").agg(F.count("*").alias("postings"))


def extraction_accuracy(labelled: DataFrame) -> DataFrame:
    """Correct / total per field and overall.

    labelled: ``job_id, field, expected, actual``; NULL equals NULL.
    """
    right = F.col("expected").eqNullSafe(F.col("actual"))
    return (
        labelled.rollup("field")
        .agg(
            F.count_if(right).alias("correct"),
            F.count("*").alias("total"),
        )
        .select(
            F.coalesce("field", F.lit("overall")).alias("field"),
            "correct",
            "total",
            F.round(F.col("correct") / F.col("total"), 4).alias("accuracy"),
        )
    )
