"""Screening decisions, prepared documents and human answers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright import schemas, wording
from placewright.functions.text import as_bool, has_text, is_approval
from placewright.operators.ingest import closed_ids

PAIR = ["candidate_id", "job_id"]


class Checked(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


def check_decisions(decisions: DataFrame, matches: DataFrame) -> Checked:
    """Decisions about shortlisted jobs, and those about any other job.

    ``pursue`` may arrive as text and leaves as a boolean.
    """
    read = decisions.withColumn("pursue", as_bool(F.col("pursue")))
    known = matches.select(*PAIR)
    return Checked(
        read.join(known, PAIR, "left_semi"), read.join(known, PAIR, "left_anti")
    )


def decision_events(valid: DataFrame) -> DataFrame:
    """Each decision, with the status it causes when the job is turned down."""
    turned_down = ~F.col("pursue")
    return valid.select(
        *PAIR,
        "seq",
        "pursue",
        "reason",
        F.when(turned_down, "skipped").alias("status"),
        F.when(turned_down, F.format_string(wording.SCREENED_OUT, "reason")).alias("notes"),
    )


def approval_queue(artifacts: DataFrame, matches: DataFrame) -> DataFrame:
    """What a reviewer is shown for each job with prepared documents.

    A match that is repeated is shown once, by the least title.
    """
    first = F.min(F.struct("title", "company")).alias("first")
    shown = matches.groupBy(*PAIR).agg(first).select(*PAIR, "first.*")
    unknown = F.lit(wording.UNKNOWN_TITLE)
    return artifacts.join(shown, PAIR, "left").select(
        *PAIR,
        F.coalesce("title", unknown).alias("title"),
        F.coalesce("company", unknown).alias("company"),
        has_text(F.col("tailored_resume")).alias("has_resume"),
        has_text(F.col("cover_letter")).alias("has_cover_letter"),
    )


def review_outcome(artifacts: DataFrame, answers: DataFrame) -> DataFrame:
    """Status of every prepared job after review; no answer means skip.

    Of several answers to one job the first by ``seq`` counts; without that column, one approval.
    """
    order = "seq" if "seq" in answers.columns else ~is_approval(F.col("answer"))
    given = answers.groupBy(*PAIR).agg(F.min_by("answer", order).alias("answer"))
    approved = is_approval(F.col("answer"))
    return (
        artifacts.select(*PAIR)
        .join(given, PAIR, "left")
        .select(
            *PAIR,
            F.when(approved, "applied").otherwise("skipped").alias("status"),
            F.when(approved, wording.REVIEW_APPROVED)
            .otherwise(wording.REVIEW_SKIPPED)
            .alias("notes"),
        )
    )


def review_counts(outcome: DataFrame) -> DataFrame:
    approved = F.col("status") == "applied"
    return outcome.groupBy("candidate_id").agg(
        F.count("*").alias("reviewed"),
        F.count_if(approved).alias("approved"),
        F.count_if(~approved).alias("skipped"),
    )


def artifact_files(artifacts: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per document to write: non-empty, and its job not given up."""
    given_up = statuses.where(F.col("status").isin("skipped", "expired")).select(*PAIR)
    kept = artifacts.join(given_up, PAIR, "left_anti")
    return (
        kept.unpivot(PAIR, list(schemas.ARTIFACT_FIELDS), "document", "content")
        .where(has_text(F.col("content")))
        .select(
            *PAIR,
            F.concat("document", F.lit(".md")).alias("file_name"),
            "content",
        )
    )


class Prepared(NamedTuple):
    artifacts: DataFrame
    statuses: DataFrame
    notes: DataFrame


def prepared_documents(drafts: DataFrame, field: str) -> Prepared:
    """What finished drafts of one kind add to the round.

    drafts: ``candidate_id, job_id, seq, draft, approved, issues, rejected``.
    ``field`` is the artifact field the draft fills. A draft counts whether
    its last review approved it or not; the note says which.
    """
    done = drafts.where(~F.col("rejected"))
    fields = [
        (F.col("draft") if name == field else F.lit(None).cast("string")).alias(name)
        for name in schemas.ARTIFACT_FIELDS
    ]
    return Prepared(
        artifacts=done.select(*PAIR, "seq", *fields),
        statuses=done.select(
            *PAIR,
            "seq",
            F.lit("tailored").alias("status"),
            F.lit(None).cast("string").alias("notes"),
        ),
        notes=done.select(
            *PAIR, review_note(F.col("approved"), F.col("issues")).alias("note")
        ),
    )


def expired_statuses(matches: DataFrame, states: DataFrame) -> DataFrame:
    """Shortlisted jobs whose latest landed state is closed.

    states: ``job_id, seq, state``. The removal of the posting itself is
    :func:`placewright.operators.ingest.drop_closed`.
    """
    return matches.select(*PAIR).join(closed_ids(states), "job_id").select(
        *PAIR,
        "seq",
        F.lit("expired").alias("status"),
        F.lit(wording.POSTING_CLOSED).alias("notes"),
    )


def review_note(approved: Column, issues: Column) -> Column:
    """One line on how a draft fared."""
    stated = F.when(
        F.coalesce(F.size(issues), F.lit(0)) > 0, F.array_join(issues, "; ")
    ).otherwise(wording.DRAFT_ISSUE_UNSPECIFIED)
    return F.when(approved, wording.DRAFT_PASSED).otherwise(
        F.format_string(wording.DRAFT_ISSUES, stated)
    )
