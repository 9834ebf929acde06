"""Model extraction in rounds, its ledger, and skills found where texts lie."""

import json

from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.predicates import skills_ok
from placewright.operators import keyed, skills
from placewright.operators.enrich import enrich_gaps
from placewright.plans import rounds
from placewright.sources.buckets import BucketTable

TEXT = "job_id string, description string"
GOOD = {"experience_requirement": {"min_years_experience": 4, "experience_requirement_evidence": "four"}}


def forgetful():
    """Gets one thing right per error it is told."""

    def answer(prompt):
        if "stubborn" in prompt:
            return "never"
        if "broken" in prompt and "REJECTED" not in prompt:
            raise ValueError("no line")
        if "shaky" in prompt and "not JSON" not in prompt and "invalid" not in prompt:
            return "well"
        if "shaky" in prompt and "min_years_experience: invalid" not in prompt:
            return json.dumps({"experience_requirement": {"min_years_experience": [], "experience_requirement_evidence": "e"}})
        return json.dumps(GOOD)

    return answer


def postings(spark):
    return spark.createDataFrame(
        [("1", "plain"), ("2", "shaky"), ("3", "stubborn"), ("4", "broken"), ("5", ""), ("6", None)], TEXT
    )


def test_each_round_is_told_what_validation_said(spark):
    got = {(r.job_id, r.attempt): (r.error, r.metadata is not None) for r in rounds.model_rounds(postings(spark), forgetful).collect()}
    assert got == {
        ("1", 1): (None, True),
        ("2", 1): ("reply: not JSON", False),
        ("2", 2): ("experience_requirement.min_years_experience: invalid", False),
        ("2", 3): (None, True),
        ("3", 1): ("reply: not JSON", False),
        ("3", 2): ("reply: not JSON", False),
        ("3", 3): ("reply: not JSON", False),
        ("4", 1): ("no line", False),
        ("4", 2): (None, True),
    }
    last = {r.job_id: (r.attempt, r.error) for r in rounds.last_attempts(rounds.model_rounds(postings(spark), forgetful, 1)).collect()}
    assert last["1"] == (1, None) and last["3"] == (1, "reply: not JSON") and len(last) == 4


def test_batches_leave_failures_pending_and_a_ledger(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/metadata", schemas.METADATA, buckets=4)
    ledger = BucketTable(spark, f"{tmp_path}/ledger", rounds.LEDGER, buckets=4)
    run = lambda batch_id: rounds.run_model_batch(postings(spark), table, ledger, batch_id, forgetful)
    entries = lambda: sorted((r.job_id, r.batch, r.attempts, r.outcome, r.reason) for r in ledger.read().collect())
    first = [("1", 0, 1, "processed", None), ("2", 0, 3, "processed", None),
             ("3", 0, 3, "failed", "reply: not JSON"), ("4", 0, 2, "processed", None)]
    run(0)
    assert entries() == first
    run(0)  # repeated after a crash
    assert entries() == first
    done = run(1)
    assert entries() == sorted([*first, ("3", 1, 3, "failed", "reply: not JSON")])
    assert {r.job_id: r.min_experience_years for r in done.metadata.collect()} == {"1": 4, "2": 4, "4": 4}


def test_a_crash_between_ledger_and_table_is_mended(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, f"{tmp_path}/metadata", schemas.METADATA, buckets=4)
    ledger = BucketTable(spark, f"{tmp_path}/ledger", rounds.LEDGER, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(table, "append", lambda *_: 1 / 0)
        try:
            rounds.run_model_batch(postings(spark), table, ledger, 0, forgetful)
        except ZeroDivisionError:
            pass
    assert table.read().count() == 0
    rounds.run_model_batch(postings(spark), table, ledger, 0, forgetful)
    assert table.read().count() == 3 and ledger.read().count() == 4


def test_a_model_can_fill_gaps(spark):
    matches = spark.createDataFrame(
        [(1, "1", "plain"), (2, "1", "plain"), (1, "3", "stubborn")], "candidate_id int, job_id string, description string"
    ).withColumn("metadata", F.lit(None).cast(schemas.NESTED_METADATA))
    out = enrich_gaps(matches, rounds.model_extractor(forgetful)).collect()
    assert sorted((r.candidate_id, r.job_id, r.metadata_from) for r in out) == [(1, "1", "extracted"), (1, "3", None), (2, "1", "extracted")]


PEOPLE = [
    (1, ["Spark", "SQL"]), (2, ["ark"]), (3, []), (4, None), (5, [None, "sql"]), (6, [None]), (7, [""]), (8, ["ÉTÉ", "spark"]),
    (9, ["no such"]),
]
JOBS = [("a", "Spark and sQl"), ("b", "sparkle"), ("c", None), ("d", ""), ("e", "été SPARK"), ("f", "SQL")]


def test_skills_equal_the_rule_on_texts(spark, monkeypatch):
    people = spark.createDataFrame(PEOPLE, "candidate_id int, must_have_skills array<string>")
    jobs = spark.createDataFrame(JOBS, TEXT)
    want = {
        (r.candidate_id, r.job_id): r.ok
        for r in people.crossJoin(jobs).select("candidate_id", "job_id", skills_ok(F.col("description"), F.col("must_have_skills")).alias("ok")).collect()
    }
    for size in (skills.SKILL_BYTES, 4):  # one pass, and several
        monkeypatch.setattr(skills, "SKILL_BYTES", size)
        numbered = skills.number_skills(people)
        pairs = skills.with_needs(people, numbered).crossJoin(skills.skill_index(jobs, numbered))
        got = {(r.candidate_id, r.job_id): r.ok for r in pairs.select("candidate_id", "job_id", skills.has_all(F.col("found"), F.col("needs")).alias("ok")).collect()}
        assert got == want


def test_no_skills_at_all(spark):
    people = spark.createDataFrame([(1, [])], "candidate_id int, must_have_skills array<string>")
    numbered = skills.number_skills(people)
    assert [r.found for r in skills.skill_index(spark.createDataFrame(JOBS, TEXT), numbered).collect()] == [[]] * 6


def test_reduced_keeps_every_wanted_row(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("job_id"), F.lit("text").alias("description"))
    wanted = rows.where("job_id % 97 = 3").select(F.col("job_id").alias("k"))
    got = {r.job_id for r in keyed.reduced(rows, "job_id", wanted).collect()}
    assert {str(k) for k in range(5000) if k % 97 == 3} <= got and len(got) < 80
    assert keyed.reduced(rows, "job_id", wanted.limit(0)).isEmpty()


def test_evidence_is_found_across_line_breaks(spark):
    from placewright.operators.enrich import evidence_spans

    text = "Costs (all) of 3.5\n  years are\tmet. Again 3.5 years are met."
    quotes = ["3.5 years are met.", "Costs (all)", "no such", "3x5 years", "  ", "years\nare met"]
    rows = [(str(k), (None, (1, q), None, None)) for k, q in enumerate(quotes)]
    stored = "struct<" + schemas.NESTED_METADATA[len("STRUCT<"):]
    nested = spark.createDataFrame(rows, f"job_id string, metadata {stored}")
    posts = spark.createDataFrame([(str(k), text) for k in range(len(quotes))], TEXT)
    got = {r.job_id: (r.start, r.stop) for r in evidence_spans(nested, posts).collect()}
    assert {k: text[a:b] for k, (a, b) in got.items() if a is not None} == {
        "0": "3.5\n  years are\tmet.", "1": "Costs (all)", "5": "years are\tmet",
    }
    assert got["2"] == got["3"] == (None, None)


def test_repeated_matches_and_answers_count_once(spark):
    from placewright.operators import review

    pair = "candidate_id int, job_id string"
    made = spark.createDataFrame([(1, "a", "cv", None)], pair + ", tailored_resume string, cover_letter string")
    seen = spark.createDataFrame([(1, "a", "t", "c"), (1, "a", "t", "c")], pair + ", title string, company string")
    assert review.approval_queue(made, seen).count() == 1
    answers = spark.createDataFrame([(1, "a", "no", 1), (1, "a", "yes", 2)], pair + ", answer string, seq int")
    assert [r.status for r in review.review_outcome(made, answers).collect()] == ["skipped"]
    assert [r.status for r in review.review_outcome(made, answers.drop("seq")).collect()] == ["applied"]
