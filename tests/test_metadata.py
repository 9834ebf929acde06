import pytest
from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.metadata import language_evidence, only_english
from placewright.operators.enrich import (
    enrich_gaps,
    evidence_grounding,
    extract_requirements,
    flatten_metadata,
    rebuild_metadata,
    validate_replies,
)


def rebuilt(spark, **flat):
    row = spark.createDataFrame([{"job_id": "1", **flat}], schemas.METADATA)
    return rebuild_metadata(row).first().metadata


def test_rebuild_of_empty_row(spark):
    assert rebuilt(spark) is None


def test_rebuild_of_full_row(spark):
    m = rebuilt(
        spark,
        min_experience_years=3,
        experience_requirement_text="3+ years of experience",
        requires_advanced_degree=False,
        education_requirement_text="Bachelor's degree required",
        visa_sponsorship_available=True,
        work_mode="hybrid",
        relocation_evidence="Visa sponsorship available",
    )
    assert m.experience_requirement.min_years_experience == 3
    assert m.higher_education_requirement.is_masters_or_phd_required is False
    assert m.relocation_requirement.work_mode == "hybrid"
    assert m.relocation_requirement.visa_sponsorship_available is True
    assert m.language_requirements is None


def test_rebuild_of_partial_row(spark):
    m = rebuilt(spark, min_experience_years=2, experience_requirement_text="2 years")
    assert m.experience_requirement.min_years_experience == 2
    assert m.relocation_requirement is None and m.higher_education_requirement is None


def test_rebuild_defaults_and_gaps(spark):
    m = rebuilt(spark, requires_advanced_degree=False, relocation_evidence="x", work_mode="")
    assert m.relocation_requirement.work_mode == "unknown"
    assert m.higher_education_requirement.education_requirement_evidence is None
    # years without evidence are not rebuilt; a bad mode drops its part only
    assert rebuilt(spark, min_experience_years=4) is None
    bad = rebuilt(spark, requires_advanced_degree=True, relocation_evidence="x", work_mode="moon")
    assert bad.relocation_requirement is None and bad.higher_education_requirement is not None


def test_flatten_undoes_rebuild(spark):
    row = {
        "job_id": "1", "min_experience_years": 3, "experience_requirement_text": "a",
        "requires_advanced_degree": True, "education_requirement_text": "b",
        "visa_sponsorship_available": False, "relocation_assistance_provided": None,
        "work_mode": "onsite", "relocation_evidence": "c",
    }
    flat = spark.createDataFrame([row], schemas.METADATA)
    back = flatten_metadata(rebuild_metadata(flat)).first().asDict()
    assert {k: back[k] for k in row} == row


@pytest.mark.parametrize(
    "languages, want",
    [
        (None, (None, None)),
        ([], (None, None)),
        ([("German", "good_to_have", "g")], (None, None)),
        ([("English", "required", "e")], (True, "e")),
        ([("English", "required", "e"), ("German", "required", "g")], (False, "e | g")),
        ([("ENGLISH", "required", "e"), ("French", "mentioned", "f")], (True, "e")),
    ],
)
def test_only_english(spark, languages, want):
    rows = None if languages is None else [(n, None, r, e) for n, r, e in languages]
    frame = spark.createDataFrame([(rows,)], f"x ARRAY<{schemas.LANGUAGE}>")
    got = frame.select(only_english(F.col("x")), language_evidence(F.col("x"))).first()
    assert tuple(got) == want


REPLIES = [
    ('{"experience_requirement":{"min_years_experience":"5","experience_requirement_evidence":"e"}}', 5, []),
    ('{"experience_requirement":{"min_years_experience":5.0,"experience_requirement_evidence":"e"}}', 5, []),
    ('{"experience_requirement":{"min_years_experience":null,"experience_requirement_evidence":"e"}}', None, []),
    ('```json\n{"experience_requirement":null}\n```', None, []),
    ("{}", None, []),
    ('{"experience_requirement":{"min_years_experience":5.5,"experience_requirement_evidence":"e"}}', None,
     ["experience_requirement.min_years_experience: invalid"]),
    ('{"experience_requirement":{"min_years_experience":99999999999,"experience_requirement_evidence":"e"}}', None,
     ["experience_requirement.min_years_experience: invalid"]),
    ('{"experience_requirement":{"min_years_experience":"five","experience_requirement_evidence":7}}', None,
     ["experience_requirement.min_years_experience: invalid",
      "experience_requirement.experience_requirement_evidence: invalid"]),
    ('{"relocation_requirement":{"work_mode":null,"relocation_evidence":"e"}}', None,
     ["relocation_requirement.work_mode: invalid"]),
    ('{"relocation_requirement":{"visa_sponsorship_available":2,"relocation_evidence":"e"}}', None,
     ["relocation_requirement.visa_sponsorship_available: invalid"]),
    ('{"language_requirements":{"language":"x"}}', None, ["language_requirements: not a list"]),
    ('{"language_requirements":["English"]}', None,
     ["language_requirements.language: invalid", "language_requirements.evidence: invalid"]),
    ("[1]", None, ["reply: not an object"]),
    ("nothing", None, ["reply: not JSON"]),
]


@pytest.mark.parametrize("reply, years, errors", REPLIES)
def test_validation(spark, reply, years, errors):
    got = validate_replies(spark.createDataFrame([("1", reply)], "job_id string, reply string")).first()
    assert got.errors == errors
    assert (got.metadata is None) == bool(errors)
    if years is not None:
        assert got.metadata.experience_requirement.min_years_experience == years


def test_validation_reads_lax_booleans_and_defaults(spark):
    reply = (
        '{"extra": 1, "language_requirements": [{"language": "English", "evidence": "e"}],'
        '"higher_education_requirement": {"is_masters_or_phd_required": "YES"},'
        '"relocation_requirement": {"visa_sponsorship_available": 0,'
        '"relocation_assistance_provided": true, "relocation_evidence": "r"}}'
    )
    m = validate_replies(spark.createDataFrame([("1", reply)], "job_id string, reply string")).first().metadata
    assert m.higher_education_requirement.is_masters_or_phd_required is True
    assert m.relocation_requirement.visa_sponsorship_available is False
    assert m.relocation_requirement.relocation_assistance_provided is True
    assert m.relocation_requirement.work_mode == "unknown"
    assert m.language_requirements[0].requirement == "required"


def extracted(spark, text):
    rows = spark.createDataFrame([("1", text)], "job_id string, description string")
    return extract_requirements(rows).first().metadata


@pytest.mark.parametrize(
    "text, years",
    [
        ("Nine years of experience in a foundry are asked for", 9),
        ("You have 14+ years behind a wheel", 14),
        ("Experience of 3 to 11 yrs with looms", 3),
        ("At least six years. A minimum of two years abroad.", 2),
        ("Thirty-one years experience, no less", 31),
        ("The mill turned 80 years in spring.", None),
        ("Our firm has 25 years of experience.", None),
        ("We look back on ten years of experience.", None),
        ("Tools are lent", None),
    ],
)
def test_experience_rule(spark, text, years):
    e = extracted(spark, "A line ahead.\n" + text).experience_requirement
    assert (e.min_years_experience if e else None) == years
    if e:
        assert e.experience_requirement_evidence in text


@pytest.mark.parametrize(
    "text, want",
    [
        ("A doctorate is essential here", True),
        ("An MSc would be a bonus", False),
        ("BSc or MSc, either will do", False),
        ("A bachelor's diploma is needed", False),
        ("Masters of their trade built this hall", None),
        ("Gloves are supplied", None),
    ],
)
def test_degree_rule(spark, text, want):
    e = extracted(spark, text).higher_education_requirement
    assert (e.is_masters_or_phd_required if e else None) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Native Thai is essential", [("Thai", "Native", "required")]),
        ("Greek is mandatory", [("Greek", None, "required")]),
        ("Some Catalan would be an advantage", [("Catalan", None, "good_to_have")]),
        ("Finnish is optional", [("Finnish", None, "good_to_have")]),
        ("The menu is printed in Korean", [("Korean", None, "mentioned")]),
        ("Guests from Turkish ferries drop in", [("Turkish", None, "mentioned")]),
        ("Hungarian is not needed", [("Hungarian", None, "not_required")]),
        ("Boots are supplied", None),
    ],
)
def test_language_rule(spark, text, want):
    found = extracted(spark, text).language_requirements
    got = [(x.language, x.level, x.requirement) for x in found] if found else None
    assert got == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("The harbour will offer visa support.", (True, None, "unknown")),
        ("We are unable to sponsor anybody.", (False, None, "unknown")),
        ("Relocation assistance is offered to cooks.", (None, True, "unknown")),
        ("The guild has no relocation budget.", (None, False, "unknown")),
        ("All shifts are remote", (None, None, "remote")),
        ("Remote is not possible, the kiln is on-site", (None, None, "onsite")),
        ("A hybrid rota from June", (None, None, "hybrid")),
        ("In-office at the lighthouse", (None, None, "onsite")),
        ("Rain coats are supplied", None),
    ],
)
def test_relocation_rules(spark, text, want):
    r = extracted(spark, text).relocation_requirement
    got = (
        (r.visa_sponsorship_available, r.relocation_assistance_provided, r.work_mode)
        if r
        else None
    )
    assert got == want


def test_rule_evidence_is_verbatim(spark):
    text = "  Sails wanted.  A minimum of 8 years!  Native Greek is mandatory. A hybrid rota\nWe cannot sponsor."
    rows = spark.createDataFrame([("1", text)], "job_id string, description string")
    checked = evidence_grounding(extract_requirements(rows), rows).collect()
    assert len(checked) == 3 and all(r.grounded for r in checked)


def test_gap_filling_keeps_rows_and_failures(spark):
    stored = "struct<" + schemas.NESTED_METADATA[len("STRUCT<"):]
    matches = spark.createDataFrame(
        [
            (1, "a", "Seven years of experience", None),
            (2, "a", "Seven years of experience", None),
            (1, "b", "", None),
            (1, "c", "text", (None, (2, "two"), None, None)),
            (1, "d", "broken", None),
        ],
        f"candidate_id int, job_id string, description string, metadata {stored}",
    )
    asked = []

    def extract(texts):
        asked.append(sorted(r.job_id for r in texts.collect()))
        return extract_requirements(texts).withColumn(
            "metadata", F.when(F.col("job_id") != "d", F.col("metadata"))
        )

    rows = enrich_gaps(matches, extract).collect()
    got = {(r.candidate_id, r.job_id): r.metadata_from for r in rows}
    assert asked == [["a", "d"]]  # each posting once, blanks never
    assert got == {(1, "a"): "extracted", (2, "a"): "extracted", (1, "b"): None,
                   (1, "c"): "stored", (1, "d"): None}
