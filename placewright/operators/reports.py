"""Fit reports, shortlists, hand-offs and posting texts.

Facts come first as typed columns; the text is one expression over them.
Texts per candidate are put together from at most ``top_k`` lines, because a
shortlist has that many rows and decisions are only valid inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright import wording as w
from placewright.functions.predicates import lower_text
from placewright.functions.core import let
from placewright.functions.text import has_text

PAIR = ["candidate_id", "job_id"]


def _two_places(score: Column) -> Column:
    return F.round(score, 2)


def _listed(items: Column) -> Column:
    return F.array_join(items, ", ")


def fit_facts(matches: DataFrame) -> DataFrame:
    """Typed facts per (candidate, job).

    ``matches`` carries the match columns, nested ``metadata`` and the
    candidate's preference columns.
    """
    required = F.col("metadata.experience_requirement.min_years_experience")
    skills, text = F.col("must_have_skills"), lower_text(F.col("description"))
    present = let(
        text,
        lambda t: F.filter(skills, lambda skill: F.contains(t, F.lower(skill))),
    )
    return matches.select(
        "*",
        required.alias("required_years"),
        (required - F.col("experience_years")).alias("years_short"),
        F.col("metadata.higher_education_requirement.is_masters_or_phd_required").alias(
            "degree_required"
        ),
        F.col("metadata.relocation_requirement").alias("relocation"),
        present.alias("skills_present"),
        let(
            text,
            lambda t: F.filter(skills, lambda skill: ~F.contains(t, F.lower(skill))),
        ).alias("skills_missing"),
    )


def _fit_lines() -> list[Column]:
    required, have = F.col("required_years"), F.col("experience_years")
    mode = F.col("relocation.work_mode")
    visa = F.col("relocation.visa_sponsorship_available")
    relocation_stated = F.col("relocation").isNotNull()
    needs_visa = F.coalesce("requires_visa_sponsorship", F.lit(False))
    some = lambda items: F.coalesce(F.size(items), F.lit(0)) > 0
    return [
        F.format_string(w.FIT_HEADER, "title", "company", "job_id"),
        F.format_string(w.FIT_SCORE, _two_places(F.col("similarity_score"))),
        F.when(required.isNull(), w.FIT_YEARS_NONE)
        .when(have.isNull(), F.format_string(w.FIT_YEARS_UNKNOWN, required))
        .when(have >= required, F.format_string(w.FIT_YEARS_MET, required, have))
        .otherwise(F.format_string(w.FIT_YEARS_SHORT, required, have, "years_short")),
        F.when(F.col("degree_required").isNull(), w.FIT_DEGREE_NOT_STATED)
        .when(F.col("degree_required"), w.FIT_DEGREE_REQUIRED)
        .otherwise(w.FIT_DEGREE_NOT_REQUIRED),
        F.when(relocation_stated, F.format_string(w.FIT_MODE, mode)).otherwise(
            w.FIT_MODE_NOT_STATED
        ),
        F.when(
            relocation_stated & needs_visa,
            F.when(visa.isNull(), w.FIT_VISA_UNKNOWN)
            .when(visa, w.FIT_VISA_YES)
            .otherwise(w.FIT_VISA_NO),
        ),
        F.when(
            some(F.col("skills_present")),
            F.format_string(w.FIT_SKILLS_PRESENT, _listed(F.col("skills_present"))),
        ),
        F.when(
            some(F.col("skills_missing")),
            F.format_string(w.FIT_SKILLS_MISSING, _listed(F.col("skills_missing"))),
        ),
        F.when(
            some(F.col("preferred_locations")),
            F.format_string(
                w.FIT_LOCATION,
                F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("unknown")),
                _listed(F.col("preferred_locations")),
            ),
        ),
    ]


def fit_report(matches: DataFrame) -> DataFrame:
    """``candidate_id, job_id, report``; lines that do not apply drop out."""
    return fit_facts(matches).select(
        *PAIR, F.concat_ws("\n", *_fit_lines()).alias("report")
    )


def asked_fit_report(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """Reports for asked (candidate, job) pairs; others get a fixed answer."""
    return (
        asked.select(*PAIR)
        .join(fit_report(matches), PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("report", F.format_string(w.NOT_SHORTLISTED, "job_id")).alias(
                "report"
            ),
        )
    )


def posting_text(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """The words of an asked posting, with its heading."""
    shown = matches.select(
        *PAIR, "title", "company", "location", "description", F.lit(True).alias("found")
    )
    place = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit(w.LOCATION_UNKNOWN))
    return (
        asked.select(*PAIR)
        .join(shown, PAIR, "left")
        .select(
            *PAIR,
            F.when(F.col("found").isNull(), F.format_string(w.NOT_SHORTLISTED, "job_id"))
            .when(
                ~has_text(F.col("description")),
                F.format_string(w.POSTING_NO_TEXT, "job_id"),
            )
            .otherwise(
                F.format_string(w.POSTING_TEXT, "title", "company", place, "description")
            )
            .alias("posting_text"),
        )
    )


def shortlist_lines(matches: DataFrame) -> DataFrame:
    """Numbered line per match, in score order."""
    window = Window.partitionBy("candidate_id").orderBy(
        F.col("similarity_score").desc(), F.col("job_id").asc()
    )
    years = F.col("metadata.experience_requirement.min_years_experience")
    bits = F.concat_ws(
        w.DASH,
        F.format_string(w.SHORTLIST_ENTRY, "line_no", "job_id", "title", "company"),
        F.format_string(w.SHORTLIST_SCORE, _two_places(F.col("similarity_score"))),
        F.nullif(F.col("location"), F.lit("")),
        F.when(years.isNotNull(), F.format_string(w.SHORTLIST_YEARS, years)),
        F.col("metadata.relocation_requirement.work_mode"),
    )
    return matches.withColumn("line_no", F.row_number().over(window)).select(
        "candidate_id", "line_no", "job_id", bits.alias("line")
    )


def _assembled(
    candidates: DataFrame, lines: DataFrame, order: str, header: str, empty: str
) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "line")))
    text = F.concat_ws(
        "\n", F.lit(header), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    )
    texts = lines.groupBy("candidate_id").agg(text.alias("text"))
    return (
        candidates.select("candidate_id")
        .distinct()
        .join(texts, "candidate_id", "left")
        .select("candidate_id", F.coalesce("text", F.lit(empty)).alias("text"))
    )


def shortlist_text(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Shortlist of every candidate as one text."""
    return _assembled(
        candidates,
        shortlist_lines(matches),
        "line_no",
        w.SHORTLIST_HEADER,
        w.SHORTLIST_EMPTY,
    )


def handoff_lines(decisions: DataFrame, matches: DataFrame) -> DataFrame:
    """One line per pursued job with the reason for it."""
    shown = matches.select(
        *PAIR, F.format_string(w.HANDOFF_TITLE, "title", "company").alias("heading")
    )
    return (
        decisions.where("pursue")
        .join(shown, PAIR, "left")
        .select(
            *PAIR,
            F.format_string(
                w.HANDOFF_ENTRY,
                "job_id",
                F.coalesce("heading", F.lit(w.HANDOFF_NO_DETAILS)),
                "reason",
            ).alias("line"),
        )
    )


def handoff_text(
    candidates: DataFrame, decisions: DataFrame, matches: DataFrame
) -> DataFrame:
    """What the next stage reads: pursued jobs only, ordered by job."""
    return _assembled(
        candidates,
        handoff_lines(decisions, matches),
        "job_id",
        w.HANDOFF_HEADER,
        w.HANDOFF_EMPTY,
    )


def decision_report(decisions: DataFrame) -> DataFrame:
    """One line per decision, in job order within each candidate."""
    verdict = F.when(F.col("pursue"), "pursue").otherwise("skip")
    return decisions.select(
        *PAIR, F.format_string(w.DECISION_LINE, "job_id", verdict, "reason").alias("line")
    ).orderBy(*PAIR)


def status_report(statuses: DataFrame) -> DataFrame:
    """One line per status with its note, in job order within each candidate."""
    line = F.concat_ws(
        w.DASH,
        F.format_string(w.STATUS_LINE, "job_id", "status"),
        F.nullif(F.col("notes"), F.lit("")),
    )
    return statuses.select(*PAIR, line.alias("line")).orderBy(*PAIR)
