"""Prompt texts filled from columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright import schemas

#: Placeholders a template may use.
SCHEMA_MARK = "{output_json}"
TEXT_MARK = "{job_description}"

DEFAULT_TEMPLATE = (
    "Read the posting below and answer with one JSON object and nothing else.\n"
    "State only what the posting says itself; leave everything else null and\n"
    "the work mode unknown. Evidence must be copied from the posting.\n\n"
    "Object layout:\n" + SCHEMA_MARK + "\n\nPosting:\n" + TEXT_MARK + "\n"
)


def output_layout() -> str:
    """The expected object, described as JSON."""
    return json.dumps(
        {
            "language_requirements": [
                {
                    "language": "text",
                    "level": "text or null",
                    "requirement": list(schemas.REQUIREMENT_LEVELS),
                    "evidence": "text",
                }
            ],
            "experience_requirement": {
                "min_years_experience": "integer or null",
                "experience_requirement_evidence": "text",
            },
            "higher_education_requirement": {
                "is_masters_or_phd_required": "boolean or null",
                "education_requirement_evidence": "text or null",
            },
            "relocation_requirement": {
                "visa_sponsorship_available": "boolean or null",
                "relocation_assistance_provided": "boolean or null",
                "work_mode": list(schemas.WORK_MODES),
                "relocation_evidence": "text",
            },
        }
    )


def fill(template: str, layout: str) -> str:
    """Template with the layout put in; done once, not per row."""
    return template.replace(SCHEMA_MARK, layout)


def build_prompt(text: Column, template: str = DEFAULT_TEMPLATE) -> Column:
    """One prompt per posting text."""
    return F.replace(F.lit(fill(template, output_layout())), F.lit(TEXT_MARK), text)


# Headings of the drafting and review prompts.
JOB_HEADING = "JOB DESCRIPTION:\n"
RESUME_HEADING = "RESUME:\n"
KIND_HEADING = "DOCUMENT TYPE: "
ORIGINAL_HEADING = "ORIGINAL RESUME:\n"
DRAFT_HEADING = "DRAFT:\n"


def draft_prompt(description: Column, resume: Column) -> Column:
    return F.concat(
        F.lit(JOB_HEADING), description, F.lit("\n\n" + RESUME_HEADING), resume
    )


def review_prompt(kind: Column, draft: Column, description: Column, resume: Column) -> Column:
    return F.concat(
        F.lit(KIND_HEADING),
        kind,
        F.lit("\n\n" + ORIGINAL_HEADING),
        resume,
        F.lit("\n\n" + JOB_HEADING),
        description,
        F.lit("\n\n" + DRAFT_HEADING),
        draft,
    )
