"""Requirement rules on sentences they were not written for; truth by hand."""

import pytest
from pyspark.sql import functions as F

from placewright.functions import rules

CASES = [
    # text, years, degree, {language: (level, requirement)}, visa, relocation
    ("Minimum 3.5 years of experience required.", 3, None, {}, None, None),
    ("Fifteen years of experience with turbines.", 15, None, {}, None, None),
    ("Over 20 years we have delivered required services.", None, None, {}, None, None),
    ("Ph.D. required.", None, True, {}, None, None),
    ("Master's degree required, PhD preferred.", None, True, {}, None, None),
    ("An M.Sc. is a plus.", None, False, {}, None, None),
    ("Fluent English required, German is a plus.", None, None, {"English": ("Fluent", "required"), "German": (None, "good_to_have")}, None, None),
    ("Fluent English and B1 German.", None, None, {"English": ("Fluent", "required"), "German": ("B1", "mentioned")}, None, None),
    ("ENGLISH REQUIRED. german is a must.", None, None, {"English": (None, "required"), "German": (None, "required")}, None, None),
    ("English, German and French required.", None, None, {n: (None, "required") for n in ("English", "German", "French")}, None, None),
    ("We provide relocation assistance but no visa sponsorship.", None, None, {}, False, True),
    ("Is visa sponsorship offered? No.", None, None, {}, None, None),
    ("Relocation support is not available; a visa sponsor is provided.", None, None, {}, True, False),
    ("Our company has 30 years of experience.", None, None, {}, None, None),
    ("5+ yrs in Python", 5, None, {}, None, None),
    ("Thirty years experience.", 30, None, {}, None, None),
    ("Forty-two years of experience at sea.", 42, None, {}, None, None),
    ("Thai fluent required.", None, None, {"Thai": ("fluent", "required")}, None, None),
    ("Graph. Dutch is needed.", None, None, {"Dutch": (None, "required")}, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, text string")
    read = frame.select("k", rules.requirements(rules.sentences(F.col("text"))).alias("m"))
    return {r["k"]: r["m"].asDict(recursive=True) for r in read.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_statement(found, k):
    text, years, degree, languages, visa, relocation = CASES[k]
    got = found[k]
    part = lambda name, field: (got[name] or {}).get(field)
    assert part("experience_requirement", "min_years_experience") == years
    assert part("higher_education_requirement", "is_masters_or_phd_required") == degree
    named = {e["language"]: (e["level"], e["requirement"]) for e in got["language_requirements"] or []}
    assert named == languages
    assert part("relocation_requirement", "visa_sponsorship_available") == visa
    assert part("relocation_requirement", "relocation_assistance_provided") == relocation
    for evidence in [e["evidence"] for e in got["language_requirements"] or []]:
        assert evidence in text
