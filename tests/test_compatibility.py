"""One posting, one rule: what keeps it and what drops it."""

import pytest

from placewright.functions.predicates import literal_preferences
from placewright.operators.compatibility import (
    compatible_jobs,
    filter_funnel,
    verdicts,
    with_metadata,
)

JOBS = "job_id string, title string, description string, location string, country string"
LYON = {"location": "Lyon, France", "country": "France"}
ECUADOR = {"location": "Quito, Ecuador", "country": "Ecuador"}
TEXT = {"description": "Our tools are Python and SQL."}


def kept(spark, job=None, facts=None, fact_types=None, **prefs):
    jobs = spark.createDataFrame([{"job_id": "1", "title": "Turbine Planner", **(job or {})}], JOBS)
    types = {
        "min_experience_years": "int",
        "requires_advanced_degree": "boolean",
        "requires_only_english": "boolean",
        "work_mode": "string",
        "visa_sponsorship_available": "boolean",
        **(fact_types or {}),
    }
    schema = "job_id string, " + ", ".join(f"{k} {t}" for k, t in types.items())
    rows = [] if facts is None else [{"job_id": "1", **facts}]
    metadata = spark.createDataFrame(rows, schema)
    out = compatible_jobs(with_metadata(jobs, metadata), literal_preferences(**prefs))
    return out.count() == 1


CASES = [
    ("more years than the candidate has", False, {}, {"min_experience_years": 5}, {"experience_years": 3}),
    ("fewer years", True, {}, {"min_experience_years": 2}, {"experience_years": 3}),
    ("equal years", True, {}, {"min_experience_years": 3}, {"experience_years": 3}),
    ("candidate years unknown", True, {}, {"min_experience_years": 10}, {}),
    ("degree required", False, {}, {"requires_advanced_degree": True}, {}),
    ("degree not required", True, {}, {"requires_advanced_degree": False}, {}),
    ("other language mandatory", False, {}, {"requires_only_english": False}, {}),
    ("language unknown", True, {}, {"requires_only_english": None}, {}),
    ("no metadata row", True, {}, None, {"experience_years": 0}),
    ("skill missing", False, TEXT, None, {"must_have_skills": ["python", "aws"]}),
    ("all skills", True, TEXT, None, {"must_have_skills": ["Python", "sql"]}),
    ("skill is part of a word", True, {"description": "JavaScript"}, None, {"must_have_skills": ["java"]}),
    ("no text but skills wanted", False, {}, None, {"must_have_skills": ["sql"]}),
    ("no skills wanted", True, {}, None, {"must_have_skills": []}),
    ("elsewhere", False, ECUADOR, None, {"preferred_locations": ["France"]}),
    ("preferred place, other case", True, LYON, None, {"preferred_locations": ["france"]}),
    ("remote anywhere", True, ECUADOR, {"work_mode": "remote"}, {"preferred_locations": ["France"]}),
    ("would move", True, ECUADOR, None, {"preferred_locations": ["France"], "open_to_relocation": True}),
    ("only blanks preferred", False, LYON, None, {"preferred_locations": [" ", "\t"]}),
    ("place over both columns", True, {"location": "", "country": "Ecuador"}, None, {"preferred_locations": ["ecuador"]}),
    ("no sponsorship", False, {}, {"visa_sponsorship_available": False}, {"requires_visa_sponsorship": True}),
    ("sponsorship unknown", True, {}, {"visa_sponsorship_available": None}, {"requires_visa_sponsorship": True}),
    ("no sponsorship, none needed", True, {}, {"visa_sponsorship_available": False}, {}),
]


@pytest.mark.parametrize("want, job, facts, prefs", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_rule(spark, want, job, facts, prefs):
    assert kept(spark, job, facts, **prefs) is want


@pytest.mark.parametrize("years, want", [("senior", True), ("3.5", True), (" 5 ", False), ("1", True)])
def test_years_that_are_text(spark, years, want):
    facts = {"min_experience_years": years}
    types = {"min_experience_years": "string"}
    assert kept(spark, {}, facts, types, experience_years=1) is want


def test_funnel_adds_up(spark):
    rows = spark.createDataFrame(
        [
            (1, "a", 9, False, "x", None),
            (1, "b", 1, None, "x", None),
            (1, "c", None, True, "x", None),
            (2, "a", 9, True, "x", None),
        ],
        "candidate_id int, job_id string, min_experience_years int, "
        "requires_advanced_degree boolean, description string, location string",
    ).selectExpr(
        "*", "cast(null as string) country", "cast(null as string) work_mode",
        "cast(null as boolean) requires_only_english",
        "cast(null as boolean) visa_sponsorship_available",
    )
    prefs = literal_preferences(experience_years=4)
    got = {r.candidate_id: r for r in filter_funnel(rows, prefs).collect()}
    assert (got[1].jobs_in, got[1].jobs_kept, got[1].jobs_dropped) == (3, 1, 2)
    assert (got[2].dropped_experience, got[2].dropped_degree, got[2].jobs_dropped) == (1, 1, 1)
    assert verdicts(rows, prefs).count() == 4
