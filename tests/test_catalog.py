"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import difference, duck
from placewright.catalog.oracle import ORACLE_SQL
from placewright.catalog.queries import QUERIES

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    problem = difference(spark, con, SF, name)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) >= 72


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:3] == ["candidate_id", "rank", "job_id"]
    assert set(QUERIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["latest_status", "merge_artifacts", "ingest_postings", "match_resumes", "filter_visa"])
def test_no_plan_multiplies_rows(spark, name):
    plan = QUERIES[name](spark, f"/root/testdata/{SF}")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_used(spark):
    frame = QUERIES["filter_experience"](spark, f"/root/testdata/{SF}")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and not any("text:string" in line for line in scans)
