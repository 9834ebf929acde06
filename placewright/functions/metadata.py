"""Requirement metadata: nested <-> flat, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.text import has_text

EVIDENCE_GLUE = " | "


def required_languages(languages: Column) -> Column:
    return F.filter(languages, lambda item: item["requirement"] == "required")


def only_english(languages: Column) -> Column:
    """NULL when no language is required, else "all required are English"."""
    required = required_languages(languages)
    return F.when(
        F.size(required) > 0,
        F.forall(required, lambda item: F.lower(item["language"]) == "english"),
    )


def language_evidence(languages: Column) -> Column:
    required = required_languages(languages)
    return F.when(
        F.size(required) > 0,
        F.array_join(F.transform(required, lambda item: item["evidence"]), EVIDENCE_GLUE),
    )


def flatten(metadata: Column) -> dict[str, Column]:
    """The ten flat columns of a nested ``metadata`` column."""
    languages = metadata["language_requirements"]
    experience = metadata["experience_requirement"]
    education = metadata["higher_education_requirement"]
    relocation = metadata["relocation_requirement"]
    return {
        "min_experience_years": experience["min_years_experience"],
        "experience_requirement_text": experience["experience_requirement_evidence"],
        "requires_only_english": only_english(languages),
        "language_requirement_text": language_evidence(languages),
        "requires_advanced_degree": education["is_masters_or_phd_required"],
        "education_requirement_text": education["education_requirement_evidence"],
        "visa_sponsorship_available": relocation["visa_sponsorship_available"],
        "relocation_assistance_provided": relocation["relocation_assistance_provided"],
        "work_mode": relocation["work_mode"],
        "relocation_evidence": relocation["relocation_evidence"],
    }


def rebuild() -> Column:
    """Nested metadata from the flat columns of the row, as far as possible.

    A part exists only where its evidence does (for education the flag alone
    is enough); with no part at all the result is NULL. The list of languages
    is not kept in the flat row and stays NULL. A work mode outside the
    allowed values makes the relocation part NULL; ``bad_work_mode`` tells.
    """
    experience = F.when(
        has_text(F.col("experience_requirement_text")),
        F.struct(
            F.col("min_experience_years").alias("min_years_experience"),
            F.col("experience_requirement_text").alias("experience_requirement_evidence"),
        ),
    ).cast(schemas.EXPERIENCE)
    education = F.when(
        F.col("requires_advanced_degree").isNotNull()
        | has_text(F.col("education_requirement_text")),
        F.struct(
            F.col("requires_advanced_degree").alias("is_masters_or_phd_required"),
            F.col("education_requirement_text").alias("education_requirement_evidence"),
        ),
    ).cast(schemas.EDUCATION)
    relocation = F.when(
        has_text(F.col("relocation_evidence")) & ~bad_work_mode(),
        F.struct(
            F.col("visa_sponsorship_available"),
            F.col("relocation_assistance_provided"),
            F.coalesce(F.nullif(F.col("work_mode"), F.lit("")), F.lit("unknown")).alias(
                "work_mode"
            ),
            F.col("relocation_evidence"),
        ),
    ).cast(schemas.RELOCATION)
    return F.when(
        experience.isNotNull() | education.isNotNull() | relocation.isNotNull(),
        F.struct(
            F.lit(None).cast(f"ARRAY<{schemas.LANGUAGE}>").alias("language_requirements"),
            experience.alias("experience_requirement"),
            education.alias("higher_education_requirement"),
            relocation.alias("relocation_requirement"),
        ),
    ).cast(schemas.NESTED_METADATA)


def bad_work_mode() -> Column:
    """True where a stored work mode is none of the allowed values."""
    return (
        has_text(F.col("relocation_evidence"))
        & has_text(F.col("work_mode"))
        & ~F.col("work_mode").isin(*schemas.WORK_MODES)
    )


def evidence_pairs(metadata: Column) -> Column:
    """``array<struct<field, evidence>>`` of all stated evidence."""

    def pair(field: str, text: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), text.alias("evidence"))

    languages = F.transform(
        F.coalesce(
            metadata["language_requirements"],
            F.array().cast(f"ARRAY<{schemas.LANGUAGE}>"),
        ),
        lambda item: pair("language", item["evidence"]),
    )
    single = F.array(
        pair(
            "experience",
            metadata["experience_requirement"]["experience_requirement_evidence"],
        ),
        pair(
            "education",
            metadata["higher_education_requirement"]["education_requirement_evidence"],
        ),
        pair("relocation", metadata["relocation_requirement"]["relocation_evidence"]),
    )
    return F.filter(
        F.concat(languages, single), lambda p: F.coalesce(p["evidence"], F.lit("")) != ""
    )
