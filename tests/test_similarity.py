import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from placewright import schemas
from placewright.operators import similarity
from placewright.operators.similarity import best_rows, topk_similar
from placewright.plans.match import match_resumes

DIM = 16


def unit(rng, n):
    x = rng.normal(size=(n, DIM)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    people, jobs = unit(rng, 23), unit(rng, 400)
    jobs[100:110] = jobs[5]  # equal vectors tie and are ordered by job id
    c = spark.createDataFrame(
        [(f"c{i}", v.tolist()) for i, v in enumerate(people)],
        "candidate_id string, resume_embedding array<float>",
    )
    j = spark.createDataFrame(
        [(str(i), v.tolist()) for i, v in enumerate(jobs)], "job_id string, embedding array<float>"
    ).repartition(5)
    return people, jobs, c, j


def brute(people, jobs, k):
    out = set()
    for i, p in enumerate(people):
        scores = np.round(jobs.astype(float) @ p.astype(float), 9)
        order = sorted(range(len(jobs)), key=lambda n: (-scores[n], str(n)))[:k]
        out |= {(f"c{i}", str(n), round(scores[n], 9), r + 1) for r, n in enumerate(order)}
    return out


def as_set(frame):
    cols = ["candidate_id", "job_id", "score", "rank"]
    return {tuple(r) for r in frame.select(cols).collect()}


@pytest.mark.parametrize("k", [1, 7, 20])
def test_candidates_equal_brute_force(tables, k):
    people, jobs, c, j = tables
    assert as_set(topk_similar(c, j, k)) == brute(people, jobs, k)


def test_small_blocks_equal_brute_force(tables, monkeypatch):
    """Many scan steps, many settling rounds."""
    people, jobs, c, j = tables
    best = similarity._scan(
        people.astype(float),
        ((np.array([str(n) for n in range(a, a + 10)], dtype=object), jobs[a : a + 10].astype(float))
         for a in range(0, 400, 10)),
        7,
    )
    want = {(w[0], w[1]) for w in brute(people, jobs, 7)}
    assert {(f"c{w}", n) for w, n in zip(best.who, best.job)} == want


def test_small_byte_blocks_give_the_same(tables, monkeypatch):
    people, jobs, c, j = tables
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 8 * 4 * DIM)
    monkeypatch.setattr(similarity, "MERGE_ROWS", 100)
    assert as_set(topk_similar(c, j, 7)) == brute(people, jobs, 7)


def test_groups_of_candidates_give_the_same(tables, monkeypatch):
    people, jobs, c, j = tables
    monkeypatch.setattr(similarity, "KEPT_AT_ONCE", 21)
    assert as_set(topk_similar(c, j, 7)) == brute(people, jobs, 7)


def test_memory_of_a_search_does_not_grow_with_candidates():
    """What is held beside the blocks and the rows handed on is bounded."""
    rng = np.random.default_rng(3)
    jobs = unit(rng, 4_000)
    others = pa.table({"job_id": [str(n) for n in range(len(jobs))], "embedding": jobs.tolist()})
    beside = []
    for n in (10_000, 40_000):
        some = pa.table({"candidate_id": np.arange(n), "resume_embedding": unit(rng, n).tolist(), "floor": pa.nulls(n, pa.float64())})
        tracemalloc.start()
        found = similarity._search(some, others, 20)
        beside.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found.num_rows == 20 * n
    # the inputs of the larger one are 2 MB more, its results 14 MB as arrays
    assert beside[1] - beside[0] < 40e6


def test_floor_keeps_ties(spark, monkeypatch):
    """Equal vectors in all cells: the floor is every score."""
    same = [1.0] + [0.0] * (DIM - 1)
    c = spark.createDataFrame([("c0", same)], "candidate_id string, resume_embedding array<float>")
    j = spark.createDataFrame([(str(n), same) for n in range(300)], "job_id string, embedding array<float>")
    got = [r.job_id for r in topk_similar(c, j, 5).orderBy("rank").collect()]
    assert got == sorted(map(str, range(300)))[:5]


def test_merge_in_pieces_gives_the_same(tables):
    people, jobs, c, j = tables
    hits = topk_similar(c, j, 12).drop("rank")
    for pieces in (1, 4):
        assert as_set(best_rows(hits, 5, pieces)) == brute(people, jobs, 5)


def test_fewer_vectors_than_wanted(spark, tables):
    _, _, c, j = tables
    few = j.where("job_id IN ('1', '2')")
    assert topk_similar(c, few, 5).count() == 46
    assert topk_similar(c.limit(0), few, 5).count() == 0
    assert topk_similar(c, j.limit(0), 5).count() == 0


def test_wrong_dimensions_are_an_error(spark, tables):
    _, _, c, _ = tables
    bad = spark.createDataFrame([("1", [1.0, 0.0])], "job_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        topk_similar(c, bad, 2).collect()


def test_match_limits_before_it_filters(spark):
    """The nearest 2k vectors are taken first: orphans and dropped postings
    use places, and what follows them does not move up."""
    def vec(x):
        return [float(x), float(np.sqrt(1 - x * x))]

    vectors = spark.createDataFrame(
        [("gone", vec(0.99)), ("phd", vec(0.98)), ("a", vec(0.97)), ("b", vec(0.96)), ("c", vec(0.95))],
        "job_id string, embedding array<float>",
    )
    candidates = spark.createDataFrame(
        [(1, [1.0, 0.0], 3, [], [], False, False)],
        "candidate_id int, resume_embedding array<float>, experience_years int, "
        "must_have_skills array<string>, preferred_locations array<string>, "
        "open_to_relocation boolean, requires_visa_sponsorship boolean",
    )
    postings = spark.createDataFrame(
        [(j, None if j == "a" else f"T{j}", "Nordwerk", "text", None, None, None) for j in ("phd", "a", "b", "c")],
        "job_id string, title string, company string, description string, "
        "location string, country string, application_url string",
    )
    metadata = spark.createDataFrame(
        [{"job_id": "phd", "requires_advanced_degree": True}], schemas.METADATA
    )
    got = match_resumes(candidates, vectors, postings, metadata, top_k=2).orderBy("rank").collect()
    assert [(r.rank, r.job_id, r.title) for r in got] == [(1, "a", ""), (2, "b", "Tb")]
    assert all(r.passed_filters for r in got) and got[0].metadata is None
    got = match_resumes(candidates, vectors, postings, metadata, 1).collect()
    assert got == []  # the two nearest are gone and filtered
    got = match_resumes(candidates, vectors, postings, metadata, 2, False).orderBy("rank").collect()
    assert [r.job_id for r in got] == ["phd", "a"]
    assert got[0].metadata.higher_education_requirement.is_masters_or_phd_required


def test_plan_ranks_before_the_shuffle(tables):
    _, _, c, j = tables
    plan = topk_similar(c, j, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
