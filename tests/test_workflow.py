import pytest
from pyspark.sql import functions as F

from placewright import schemas
from placewright.operators import folds, inference, reports, review
from placewright.plans.screening import screening_round
from placewright.sources import resumes, tables

MATCH = (
    "candidate_id int, job_id string, title string, company string, location string, "
    f"description string, similarity_score double, metadata {schemas.NESTED_METADATA}, "
    "experience_years int, must_have_skills array<string>, preferred_locations array<string>, "
    "requires_visa_sponsorship boolean"
)


def match(job="42", metadata=None, **more):
    return {
        "candidate_id": 1, "job_id": job, "title": "Turbine Planner", "company": "Nordwerk",
        "similarity_score": 0.64, "description": "Plan turbine service with Python.",
        "metadata": metadata, "must_have_skills": [], "preferred_locations": [], **more,
    }


def matches(spark, *rows):
    return spark.createDataFrame(list(rows) or [match()], MATCH)


def report(spark, **kw):
    return reports.fit_report(matches(spark, match(**kw))).first().report


EXP5 = (None, (5, "5+ years required"), None, None)


def test_fit_report_years_and_skills(spark):
    text = report(spark, metadata=EXP5, experience_years=3, must_have_skills=["Python", "Kubernetes"])
    assert text.split("\n") == [
        "Fit report for Turbine Planner at Nordwerk (job 42):",
        "- resume similarity score: 0.64",
        "- experience: requires 5+ years; candidate has 3 (short by 2)",
        "- education: requirement not stated",
        "- work mode / visa: not stated",
        "- must-have skills mentioned: Python",
        "- must-have skills NOT mentioned: Kubernetes",
    ]


@pytest.mark.parametrize(
    "kw, line",
    [
        ({"metadata": EXP5, "experience_years": 5}, "candidate has 5 (meets requirement)"),
        ({"metadata": EXP5}, "candidate years unknown"),
        ({}, "no explicit minimum stated"),
        ({"metadata": (None, None, (True, None), None)}, "explicitly requires a Master's degree or PhD"),
        ({"metadata": (None, None, (False, None), None)}, "advanced degree not required"),
        ({"metadata": (None, None, None, (None, None, "hybrid", "e"))}, "work mode: hybrid"),
        ({"metadata": (None, None, None, (True, None, "onsite", "e")), "requires_visa_sponsorship": True},
         "sponsorship available (candidate needs it)"),
        ({"metadata": (None, None, None, (False, None, "onsite", "e")), "requires_visa_sponsorship": True},
         "NO sponsorship"),
        ({"metadata": (None, None, None, (None, None, "onsite", "e")), "requires_visa_sponsorship": True},
         "sponsorship unknown"),
        ({"preferred_locations": ["Germany", "India"]}, "location: unknown (candidate prefers: Germany, India)"),
        ({"preferred_locations": ["India"], "location": "Pune"}, "location: Pune (candidate prefers: India)"),
    ],
)
def test_fit_report_lines(spark, kw, line):
    assert line in report(spark, **kw)


def test_visa_line_only_when_needed(spark):
    assert "visa:" not in report(spark, metadata=(None, None, None, (False, None, "onsite", "e")))


def test_asked_report_and_posting_text(spark):
    m = matches(spark, match(), match("43", description="", location="Pune"))
    asked = spark.createDataFrame([(1, "42"), (1, "43"), (1, "zzz")], "candidate_id int, job_id string")
    text = {r.job_id: r.posting_text for r in reports.posting_text(asked, m).collect()}
    assert text["42"] == "Turbine Planner at Nordwerk (location unknown):\n\nPlan turbine service with Python."
    assert text["43"] == "Job 43 has no stored description."
    assert text["zzz"] == "No shortlisted job with job_id=zzz."
    got = {r.job_id: r.report for r in reports.asked_fit_report(asked, m).collect()}
    assert got["zzz"] == "No shortlisted job with job_id=zzz." and got["42"].startswith("Fit report")


def test_shortlist_text(spark):
    people = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    m = matches(
        spark,
        match("43", similarity_score=0.5, location="Pune", metadata=(None, (2, "e"), None, (None, None, "remote", "e"))),
        match("42"),
    )
    text = {r.candidate_id: r.text for r in reports.shortlist_text(people, m).collect()}
    assert text[1] == (
        "Shortlisted jobs:\n1. [42] Turbine Planner at Nordwerk — score 0.64\n"
        "2. [43] Turbine Planner at Nordwerk — score 0.50 — Pune — 2y exp — remote"
    )
    assert text[2] == "No matching jobs were found for this resume."


DECISION = "candidate_id int, job_id string, seq int, pursue string, reason string"


def test_decisions_of_unknown_jobs_are_rejected(spark):
    rows = spark.createDataFrame([(1, "42", 1, "yes", "r"), (1, "zzz", 2, "true", "r")], DECISION)
    out = review.check_decisions(rows, matches(spark))
    assert [r.job_id for r in out.valid.collect()] == ["42"]
    assert [r.job_id for r in out.rejected.collect()] == ["zzz"]


def test_decision_events(spark):
    rows = spark.createDataFrame([(1, "42", 1, "false", "other field"), (1, "42", 2, "1", "ok")], DECISION)
    valid = review.check_decisions(rows, matches(spark)).valid
    got = {r.seq: (r.pursue, r.status, r.notes) for r in review.decision_events(valid).collect()}
    assert got == {1: (False, "skipped", "screened out: other field"), 2: (True, None, None)}


def test_handoff_shows_pursued_only(spark):
    people = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    rows = spark.createDataFrame(
        [(1, "42", 1, True, "close match"), (1, "43", 2, False, "weak match"), (1, "9", 3, True, "lost")],
        "candidate_id int, job_id string, seq int, pursue boolean, reason string",
    )
    text = {r.candidate_id: r.text for r in reports.handoff_text(people, rows, matches(spark)).collect()}
    assert text[1] == (
        "Jobs selected for application preparation:\n"
        "- [42] Turbine Planner at Nordwerk — screener's reason: close match\n"
        "- [9] (job details missing) — screener's reason: lost"
    )
    assert text[2] == "No jobs were selected by the screener."


ARTIFACT = "candidate_id int, job_id string, seq int, tailored_resume string, cover_letter string"


def test_artifact_fields_merge(spark):
    rows = spark.createDataFrame(
        [(1, "42", 1, "R", None), (1, "42", 2, None, "C"), (1, "43", 1, "old", "x"), (1, "43", 2, "new", "")], ARTIFACT
    )
    got = {r.job_id: (r.tailored_resume, r.cover_letter) for r in folds.merge_artifacts(rows).collect()}
    assert got == {"42": ("R", "C"), "43": ("new", "")}


def test_last_status_replaces_whole_record(spark):
    rows = spark.createDataFrame(
        [(1, "42", 1, "expired", "note"), (1, "42", 2, "tailored", None)],
        "candidate_id int, job_id string, seq int, status string, notes string",
    )
    assert tuple(folds.latest_status(rows).first()) == (1, "42", "tailored", None)


def test_thread_summary(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (1, 2, "assistant", ""), (2, 0, "user", "u")],
        "thread_id int, turn int, role string, text string",
    )
    assert {tuple(r) for r in folds.thread_summary(rows).collect()} == {(1, "a"), (2, None)}
    assert folds.append_messages(rows, rows).count() == 8


def test_routes(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "candidate_id int")
    rows = spark.createDataFrame([(1, True), (1, False), (2, False)], "candidate_id int, pursue boolean")
    got = {r.candidate_id: r.next_step for r in folds.any_pursued(people, rows).collect()}
    assert got == {1: "preparer", 2: "human_review", 3: "human_review"}


def test_accuracy(spark):
    rows = spark.createDataFrame(
        [("1", "a", "5", "5"), ("2", "a", None, None), ("3", "a", None, "1"), ("1", "b", "x", "y")],
        "job_id string, field string, expected string, actual string",
    )
    got = {r.field: (r.correct, r.total, r.accuracy) for r in folds.extraction_accuracy(rows).collect()}
    assert got == {"a": (2, 3, 0.6667), "b": (0, 1, 0.0), "overall": (2, 4, 0.5)}


def test_review_notes(spark):
    rows = spark.createDataFrame(
        [(True, []), (False, ["a", "b"]), (False, [])], "approved boolean, issues array<string>"
    )
    got = [r[0] for r in rows.select(review.review_note(F.col("approved"), F.col("issues"))).collect()]
    assert got == [
        "passed the truthfulness review",
        "review still flags issues after revision: a; b",
        "review still flags issues after revision: unspecified",
    ]


def test_whole_round(spark, tmp_path):
    people = spark.createDataFrame([(1,)], "candidate_id int")
    m = matches(spark, match("42"), match("43"), match("44"))
    decisions = spark.createDataFrame(
        [(1, "42", 1, "yes", "fit"), (1, "43", 2, "no", "poor"), (1, "44", 3, "yes", "fit"), (1, "zz", 4, "yes", "?")],
        DECISION,
    )
    deltas = spark.createDataFrame([(1, "42", 1, "R", None), (1, "42", 2, None, "C"), (1, "44", 3, "R4", None)], ARTIFACT)
    answers = spark.createDataFrame([(1, "42", " Y ")], "candidate_id int, job_id string, answer string")
    out = screening_round(people, m, decisions, deltas, answers)
    assert out.unknown_decisions.count() == 1
    assert out.routes.first().next_step == "preparer"
    assert "[42]" in out.handoff.first().text and "[43]" not in out.handoff.first().text
    queue = {r.job_id: (r.has_resume, r.has_cover_letter) for r in out.queue.collect()}
    assert queue == {"42": (True, True), "44": (True, False)}
    status = {r.job_id: (r.status, r.notes) for r in out.statuses.collect()}
    assert status == {
        "42": ("applied", "approved at human review"),
        "43": ("skipped", "screened out: poor"),
        "44": ("skipped", "skipped at human review"),
    }
    assert {(r.job_id, r.file_name) for r in out.files.collect()} == {
        ("42", "tailored_resume.md"), ("42", "cover_letter.md")
    }
    tables.write_artifact_folders(out.files, str(tmp_path / "out"))
    folder = tmp_path / "out" / "candidate_id=1" / "job_id=42" / "file_name=cover_letter.md"
    assert [p.read_text() for p in folder.glob("*.txt")] == ["C\n"]


def test_queue_defaults(spark):
    deltas = spark.createDataFrame([(1, "9", "", None)], "candidate_id int, job_id string, tailored_resume string, cover_letter string")
    row = review.approval_queue(deltas, matches(spark)).first()
    assert (row.title, row.company, row.has_resume, row.has_cover_letter) == ("?", "?", False, False)


def test_load_candidates(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("line one\nline two", encoding="utf-8")
    row = resumes.load_candidates(spark, str(tmp_path)).first()
    assert row.resume_text == "line one\nline two" and row.candidate_id == "ann.txt"
    assert row.experience_years == 3 and row.must_have_skills == []


def test_texts_are_files_dealt_over_many_shelves(spark, tmp_path):
    rows = [(f"{n} ü/%", f"text {n}\nline") for n in range(300)]
    texts = spark.createDataFrame(rows, "message string, value string").coalesce(1)
    resumes.write_texts(texts, str(tmp_path / "out"), "message")
    files = [*(tmp_path / "out").glob("shelf=*/message=*/*.txt")]
    assert len(files) == 300
    # few bytes, yet neither written nor listed by one task
    assert len({f.parent.parent for f in files}) > 32
    people = resumes.load_candidates(spark, str(tmp_path / "out"), r"message=([^/]+)/").collect()
    assert sorted(r.resume_text for r in people) == sorted(text + "\n" for _, text in rows)
    assert len({r.candidate_id for r in people}) == 300


def test_files_are_those_that_spark_writes(spark, tmp_path, monkeypatch):
    """Names with odd characters, keys that repeat, null keys and texts."""
    rows = [(f"a{c}b", f"text {n}") for n, c in enumerate("\t\"#%'*/:=?\\{[]^ +ü&,;!@~}|<>()\x7f")]
    rows += [("twice", "same"), ("twice", "same"), (None, "no key"), ("", "no name"), ("none", None), ("empty", "")]
    texts = spark.createDataFrame(rows, "message string, value string").coalesce(1)

    resumes.write_texts(texts.limit(0), str(tmp_path / "nothing"), "message")
    assert resumes.load_candidates(spark, str(tmp_path / "nothing")).count() == 0

    def read(name):
        resumes.write_texts(texts, str(tmp_path / name), "message")
        people = resumes.load_candidates(spark, str(tmp_path / name), r"message=([^/]+)/").collect()
        return sorted((r.candidate_id, sorted(r.resume_text.split("\n"))) for r in people)

    monkeypatch.setattr(resumes, "LEAST_SHELVES", 1)  # null and empty keys meet
    own = read("own")
    monkeypatch.setattr(resumes, "mounted_path", lambda *_: None)
    assert own == read("spark")


# ---- injected functions -----------------------------------------------------


def forgetful_model():
    def answer(prompt):
        if "REJECTED\nnot good" in prompt:
            return "good"
        if "explode" in prompt:
            raise RuntimeError("model down")
        return "bad"

    return answer


def check_good(reply):
    return None if reply == "good" else "not good"


def test_extract_with_retry(spark):
    rows = spark.createDataFrame([("1", "p"), ("2", "explode")], "job_id string, prompt string")
    got = {r.job_id: r for r in inference.extract_with_retry(rows, forgetful_model, check_good).collect()}
    assert (got["1"].reply, got["1"].attempts, got["1"].ok, got["1"].error) == ("good", 2, True, None)
    assert (got["2"].reply, got["2"].attempts, got["2"].ok, got["2"].error) == (None, 3, False, "model down")


def revising_drafter():
    return lambda kind, text, resume, earlier, issues: "fixed: " + issues[0] if issues else "first"


def stubborn_drafter():
    return lambda *a: "still bad"


def picky_judge():
    return lambda kind, draft, text, resume: (draft.startswith("fixed"), [] if draft.startswith("fixed") else ["claims a doctorate"])


JOBS = "candidate_id int, job_id string, description string, resume_text string"


def test_drafts_are_revised_with_the_issues(spark):
    rows = spark.createDataFrame([(1, "42", "jd", "r"), (1, "43", "", "r"), (1, "44", None, "r")], JOBS)
    got = {r.job_id: r for r in inference.reviewed_drafts(rows, "k", revising_drafter, picky_judge).collect()}
    assert (got["42"].draft, got["42"].approved, got["42"].rounds) == ("fixed: claims a doctorate", True, 1)
    assert got["43"].rejected and got["43"].draft is None and got["44"].rejected


def test_drafting_gives_up(spark):
    rows = spark.createDataFrame([(1, "42", "jd", "r")], JOBS)
    row = inference.reviewed_drafts(rows, "k", stubborn_drafter, picky_judge).first()
    assert (row.draft, row.approved, row.rounds, row.issues) == ("still bad", False, 2, ["claims a doctorate"])


def test_drafts_become_events(spark):
    rows = spark.createDataFrame([(1, "42", "jd", "r"), (1, "43", "", "r")], JOBS)
    drafts = inference.reviewed_drafts(rows, "k", stubborn_drafter, picky_judge).withColumn("seq", F.lit(5))
    out = review.prepared_documents(drafts, "cover_letter")
    row = out.artifacts.first()
    assert (row.job_id, row.tailored_resume, row.cover_letter) == ("42", None, "still bad")
    assert [(r.job_id, r.status) for r in out.statuses.collect()] == [("42", "tailored")]
    assert out.notes.first().note == "review still flags issues after revision: claims a doctorate"


def test_expired_statuses(spark):
    states = spark.createDataFrame(
        [("42", 1, "LISTED"), ("42", 2, "CLOSED"), ("9", 1, "CLOSED")], "job_id string, seq int, state string"
    )
    got = review.expired_statuses(matches(spark, match("42"), match("43")), states).collect()
    assert [(r.job_id, r.seq, r.status) for r in got] == [("42", 2, "expired")]


def test_ordered_lines(spark):
    decisions = spark.createDataFrame(
        [(1, "9", False, "no"), (1, "42", True, "fit")], "candidate_id int, job_id string, pursue boolean, reason string"
    )
    assert [r.line for r in reports.decision_report(decisions).collect()] == ["42: pursue — fit", "9: skip — no"]
    statuses = spark.createDataFrame(
        [(1, "9", "applied", None), (1, "42", "skipped", "why")], "candidate_id int, job_id string, status string, notes string"
    )
    assert [r.line for r in reports.status_report(statuses).collect()] == ["42: skipped — why", "9: applied"]


def _vectors_of(size):
    return lambda: lambda texts: [[float(size)] + [0.0] * (size - 1) for _ in texts]


def test_each_loader_gets_its_own_result(spark):
    """Two closures of one factory, and two lambdas of one module, in one session."""
    from placewright.operators.inference import embed_postings, extract_with_retry, reviewed_drafts

    rows = spark.createDataFrame([("1", "text")], "job_id string, description string")
    sizes = [len(embed_postings(rows, _vectors_of(n)).first().embedding) for n in (2, 5)]
    assert sizes == [2, 5]
    prompts = spark.createDataFrame([("1", "p")], "job_id string, prompt string")
    replies = [
        extract_with_retry(prompts, loader, lambda reply: None).first().reply
        for loader in (lambda: lambda prompt: "one", lambda: lambda prompt: "two")
    ]
    assert replies == ["one", "two"]
    jobs = spark.createDataFrame(
        [(1, "j", "text", "cv")], "candidate_id int, job_id string, description string, resume_text string"
    )

    def judge():
        return lambda *_: (True, [])

    drafts = [
        reviewed_drafts(jobs, "letter", loader, judge).first().draft
        for loader in (lambda: lambda *_: "first", lambda: lambda *_: "second")
    ]
    assert drafts == ["first", "second"]


def test_a_failing_call_gives_a_row(spark):
    from placewright.operators.inference import reviewed_drafts

    jobs = spark.createDataFrame(
        [(1, "bad", "text", "cv"), (1, "good", "text two", "cv")],
        "candidate_id int, job_id string, description string, resume_text string",
    )

    def drafter():
        def draft(kind, description, *_):
            if description == "text":
                raise RuntimeError("no answer")
            return "draft"

        return draft

    def judge():
        return lambda *_: (True, [])

    got = {r.job_id: r for r in reviewed_drafts(jobs, "letter", drafter, judge).collect()}
    assert got["good"].approved and got["good"].draft == "draft"
    assert not got["bad"].approved and got["bad"].draft is None and got["bad"].issues == ["failed: no answer"]
