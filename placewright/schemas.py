"""Table and nested types.

NULL always means "not known". No rule may treat it as "no".
"""

from __future__ import annotations

# Allowed literals.
REQUIREMENT_LEVELS = ("required", "good_to_have", "not_required", "mentioned")
WORK_MODES = ("remote", "hybrid", "onsite", "unknown")
STATUSES = (
    "shortlisted",
    "tailored",
    "awaiting_approval",
    "applied",
    "skipped",
    "expired",
)

ID_STATUS = "job_id STRING, is_scraped BOOLEAN"

POSTINGS = (
    "job_id STRING, title STRING, company STRING, description STRING, "
    "location STRING, posted_at TIMESTAMP_NTZ, application_url STRING, country STRING"
)
POSTINGS_NOT_NULL = ("job_id", "title", "company", "description")

#: Flat requirement row, one per posting.
METADATA = (
    "job_id STRING, min_experience_years INT, experience_requirement_text STRING, "
    "requires_only_english BOOLEAN, language_requirement_text STRING, "
    "requires_advanced_degree BOOLEAN, education_requirement_text STRING, "
    "visa_sponsorship_available BOOLEAN, relocation_assistance_provided BOOLEAN, "
    "work_mode STRING, relocation_evidence STRING"
)
METADATA_COLUMNS = tuple(part.split()[0] for part in METADATA.split(", "))

LANGUAGE = (
    "STRUCT<language: STRING, level: STRING, requirement: STRING, evidence: STRING>"
)
EXPERIENCE = (
    "STRUCT<min_years_experience: INT, experience_requirement_evidence: STRING>"
)
EDUCATION = (
    "STRUCT<is_masters_or_phd_required: BOOLEAN, "
    "education_requirement_evidence: STRING>"
)
RELOCATION = (
    "STRUCT<visa_sponsorship_available: BOOLEAN, "
    "relocation_assistance_provided: BOOLEAN, work_mode: STRING, "
    "relocation_evidence: STRING>"
)
#: Nested requirements, the type of every ``metadata`` column.
NESTED_METADATA = (
    f"STRUCT<language_requirements: ARRAY<{LANGUAGE}>, "
    f"experience_requirement: {EXPERIENCE}, "
    f"higher_education_requirement: {EDUCATION}, "
    f"relocation_requirement: {RELOCATION}>"
)

VECTORS = "job_id STRING, embedding ARRAY<FLOAT>"

ARTIFACT_FIELDS = ("tailored_resume", "cover_letter")
