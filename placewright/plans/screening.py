"""Shortlist, decisions, documents and statuses of one screening round."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators import folds, reports, review


class Round(NamedTuple):
    decisions: DataFrame
    unknown_decisions: DataFrame
    routes: DataFrame
    handoff: DataFrame
    artifacts: DataFrame
    queue: DataFrame
    statuses: DataFrame
    files: DataFrame


def screening_round(
    candidates: DataFrame,
    matches: DataFrame,
    decision_rows: DataFrame,
    artifact_deltas: DataFrame,
    answers: DataFrame,
) -> Round:
    """Fold the events of a round into its reports.

    Statuses come from turned-down decisions first and from the review of
    prepared documents after that; the later one of a job counts.
    """
    checked = review.check_decisions(decision_rows, matches)
    decisions = folds.last_write(checked.valid, ["pursue", "reason"])
    artifacts = folds.merge_artifacts(artifact_deltas)
    outcome = review.review_outcome(artifacts, answers)
    turned_down = review.decision_events(checked.valid).where(F.col("status").isNotNull())
    statuses = folds.last_write(
        turned_down.select(
            "candidate_id",
            "job_id",
            F.struct(F.lit(0).alias("step"), "seq").alias("seq"),
            "status",
            "notes",
        ).unionByName(
            outcome.select(
                "candidate_id",
                "job_id",
                F.struct(F.lit(1).alias("step"), F.lit(0).cast("long").alias("seq")).alias(
                    "seq"
                ),
                "status",
                "notes",
            )
        ),
        ["status", "notes"],
    )
    return Round(
        decisions=decisions,
        unknown_decisions=checked.rejected,
        routes=folds.any_pursued(candidates, decisions),
        handoff=reports.handoff_text(candidates, decisions, matches),
        artifacts=artifacts,
        queue=review.approval_queue(artifacts, matches),
        statuses=statuses,
        files=review.artifact_files(artifacts, statuses),
    )
