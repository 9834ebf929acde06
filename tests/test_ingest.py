import json

import pytest
from pyspark.sql import functions as F

from placewright import schemas
from placewright.operators import ingest, keyed
from placewright.plans.ingest import load_details, run_embed_batch, run_extract_batch
from placewright.sources import payloads, tables
from placewright.operators.inference import WordHashEncoder
from placewright.operators.enrich import extract_requirements


def ids(frame):
    return sorted(r.job_id for r in frame.collect())


def test_new_ids_once(spark):
    known = spark.createDataFrame([("1",)], "job_id string")
    incoming = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "job_id string")
    rows = ingest.new_ids(known, incoming).collect()
    assert [(r.job_id, r.is_scraped) for r in rows] == [("2", False)]
    again = known.union(ingest.new_ids(known, incoming).select("job_id"))
    assert ingest.new_ids(again, incoming).count() == 0


def test_first_complete_row_wins(spark):
    known = spark.createDataFrame([("k",)], "job_id string")
    arrivals = spark.createDataFrame(
        [(1, "a", "t1", None, "d"), (2, "a", "t2", "c", "d"), (3, "a", "t3", "c", "d"),
         (4, "k", "t", "c", "d"), (5, "x", None, "c", "d")],
        "n int, job_id string, title string, company string, description string",
    )
    out = ingest.ingest_postings(known, arrivals, [F.col("n")])
    assert [(r.job_id, r.title) for r in out.inserted.collect()] == [("a", "t2")]
    assert sorted((r.n, r.missing) for r in out.rejected.collect()) == [(1, "company"), (5, "title")]
    assert ids(out.scraped_ids) == ["a", "k"]  # x is tried again


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("a", 1, "x", 0), ("b", 1, "x", 0)], "job_id string, v int, w string, seq int")
    new = spark.createDataFrame([("a", 2, None, 1)], "job_id string, v int, w string, seq int")
    rows = {r.job_id: (r.v, r.w) for r in ingest.upsert(old, new).collect()}
    assert rows == {"a": (2, None), "b": (1, "x")}


def test_exclude_titles(spark):
    rows = spark.createDataFrame(
        [("1", "Summer INTERN"), ("2", "Partner"), ("3", "Engineer"), ("4", None)], "job_id string, title string"
    )
    out = ingest.exclude_titles(rows)
    assert ids(out.kept) == ["3", "4"] and out.removed.count() == 2
    assert ids(ingest.exclude_titles(rows, ["%engineer%"]).kept) == ["1", "2", "4"]


def test_drop_closed_uses_latest_state(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string")
    states = spark.createDataFrame(
        [("1", 1, "LISTED"), ("1", 2, "CLOSED"), ("2", 1, "CLOSED"), ("2", 2, "LISTED")],
        "job_id string, seq int, state string",
    )
    assert ids(ingest.drop_closed(rows, states)) == ["2", "3"]


def test_pending_and_state(spark):
    one = spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string")
    two = one.where("job_id < '3'")
    three = one.where("job_id < '2'")
    assert ids(keyed.pending(one, two)) == ["3"]
    assert keyed.hydrate(three.limit(0), one).count() == 0
    got = {r.job_id: tuple(r)[1:] for r in keyed.processing_state(one, two, three, three.limit(0)).collect()}
    assert got == {"1": (True, True, False), "2": (True, False, False), "3": (False, False, False)}


def test_constraint_audit(spark):
    status = spark.createDataFrame([("1", True), ("1", None)], "job_id string, is_scraped boolean")
    posts = spark.createDataFrame([("1", None, "c", "d")], "job_id string, title string, company string, description string")
    meta = spark.createDataFrame([{"job_id": "9"}], schemas.METADATA)
    vec = spark.createDataFrame([("1", [1.0])], schemas.VECTORS)
    got = {(r.table_name, r.rule): r.violations for r in ingest.constraint_audit(status, posts, meta, vec).collect()}
    assert got[("id_status", "job_id unique")] == 1
    assert got[("id_status", "is_scraped not null")] == 1
    assert got[("postings", "title not null")] == 1
    assert got[("metadata", "job_id references postings")] == 1
    assert sum(got.values()) == 4 and len(got) == 10


def payload(**changes):
    data = {
        "description": {"text": " Build \n things "},
        "title": "Turbine Planner",
        "formattedLocation": "Berlin, Germany",
        "originalListedAt": 0,
        "jobState": "LISTED",
        "applyMethod": {"companyApplyUrl": "https://a"},
        "companyDetails": {"companyName": "Nordwerk"},
    }
    included = changes.pop("included", [])
    data.update(changes)
    return json.dumps({"data": {k: v for k, v in data.items() if v != "drop"}, "included": included})


COMPANY = {"$type": payloads.COMPANY_TYPE, "name": "From included"}


@pytest.mark.parametrize(
    "text, want",
    [
        (payload(), ("Nordwerk", "https://a")),
        (payload(applyMethod={"companyApplyUrl": "", "easyApplyUrl": "https://e"}), ("Nordwerk", "https://e")),
        (payload(applyMethod="drop"), ("Nordwerk", "")),
        (payload(companyDetails={}, included=[{"$type": "x"}, COMPANY]), ("From included", "https://a")),
        (payload(companyDetails="drop"), (None, "https://a")),
        (payload(description={}), "no description"),
        (payload(title="drop"), "no title"),
        (payload(originalListedAt="drop"), "no listing time"),
        (payload(formattedLocation="drop"), "no location"),
        ("{broken", "not readable"),
    ],
)
def test_detail_payloads(spark, text, want):
    rows = spark.createDataFrame([("1", text)], "job_id string, payload string")
    out = payloads.parse_posting_details(rows, ["Germany", "India"])
    if isinstance(want, str):
        assert out.postings.count() == 0
        assert out.rejected.first().reason == want
    else:
        row = out.postings.first()
        assert (row.company, row.application_url) == want
        assert row.description == "Build things" and row.country == "Germany"
        assert out.rejected.count() == 0


def test_search_page(spark):
    page = {
        "data": {
            "paging": {"total": 2},
            "elements": [
                {"$type": "a.JobCard", "jobCardUnion": {"*jobPostingCard": "urn:x:(7,SEARCH)"}},
                {"$type": "a.Promo", "jobCardUnion": {"*jobPostingCard": "urn:x:(8,SEARCH)"}},
            ],
        }
    }
    rows = spark.createDataFrame([(0, json.dumps(page)), (1, "no json")], "page_no int, payload string")
    got = payloads.parse_search_pages(rows).collect()
    assert [(r.page_no, r.total, r.job_id) for r in got] == [(0, 2, "7")]


def test_load_details_end_to_end(spark):
    rows = spark.createDataFrame(
        [("1", payload()), ("2", payload(title="Part time")), ("3", payload(companyDetails={})), ("4", "{")],
        "job_id string, payload string",
    )
    known = spark.createDataFrame([], "job_id string")
    out = load_details(rows, known, ["Germany"], [F.col("posted_at")])
    assert ids(out.postings) == ["1"] and ids(out.excluded) == ["2"]
    assert ids(out.ingest.rejected) == ["3"] and ids(out.unreadable) == ["4"]
    again = load_details(rows, out.postings.select("job_id"), ["Germany"], [F.col("posted_at")])
    assert ids(again.ingest.inserted) == ["2"]


def test_extract_batch_retries_only_failures(spark, tmp_path):
    posts = spark.createDataFrame(
        [("1", "Eleven years of experience with kilns"), ("2", "bad")], "job_id string, description string"
    )
    seen = []

    def flaky(rows):
        seen.append(ids(rows))
        out = extract_requirements(rows)
        return out.withColumn("metadata", F.when(F.col("job_id") != "2", F.col("metadata")))

    table = str(tmp_path / "metadata")
    first = run_extract_batch(spark, posts, table, 0, flaky)
    assert ids(first) == ["1"]
    assert ids(run_extract_batch(spark, posts, table, 0, flaky)) == ["1"]  # batch repeated
    assert ids(run_extract_batch(spark, posts, table, 1, flaky)) == ["1"]
    assert ids(run_extract_batch(spark, posts, table, 2)) == ["1", "2"]
    assert seen == [["1", "2"], ["1", "2"], ["2"]]


def test_embed_batch_appends_and_skips_blanks(spark, tmp_path):
    posts = spark.createDataFrame([("1", "a b"), ("2", ""), ("3", None)], "job_id string, description string")
    table = str(tmp_path / "vectors")
    assert ids(run_embed_batch(spark, posts, table, 0, WordHashEncoder)) == ["1"]
    more = posts.union(spark.createDataFrame([("4", "c")], posts.schema))
    rows = run_embed_batch(spark, more, table, 1, WordHashEncoder)
    assert ids(rows) == ["1", "4"]
    assert rows.count() == 2 and tables.read_table(spark, str(tmp_path / "none"), schemas.VECTORS).count() == 0
