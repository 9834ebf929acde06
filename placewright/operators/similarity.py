"""Exact nearest postings for every candidate.

The score is the inner product of unit vectors. Every candidate meets every
vector, so the work is candidates x vectors x dimensions whatever the plan;
what the plan decides is what moves. Both sides are cut into hashed blocks of
bounded bytes, and each pair of blocks meets in one task (``cogroup``): nothing
goes through the driver and no task holds more than one pair of blocks. Within
a task, candidates are searched in groups of bounded results, with job ids as
numbers, so that beside the blocks it holds the rows it hands on and little else.

The first block of vectors is searched first. The ``k``-th score a candidate
finds there is a floor for its final ``k``-th score; it travels with the
candidate, so that the other blocks hand on only what reaches it.

Equal scores are ordered by ``job_id`` as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placewright.functions.vectors import SCORE_PLACES, similarity

#: Bytes (float32) of a block of vectors; candidates come in blocks of half of it, as
#: they bring ``k`` results each. A row is sent once per block of the other side, so
#: larger blocks mean less traffic.
BLOCK_BYTES = 32 * 1024 * 1024
#: Best rows (candidates x k) kept at once while scanning; four times as many may wait.
KEPT_AT_ONCE = 100_000
#: Scores held at once while scanning (8 bytes each).
SCORES_AT_ONCE = 4_000_000
#: Partial results of one candidate that are ranked in one piece.
MERGE_ROWS = 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float32)
    if len(column) == 0:
        return flat.reshape(0, 0)
    if len(flat) % len(column):
        raise ValueError("vectors of one table must all have the same length")
    return flat.reshape(len(column), -1)


class _Best:
    """The best ``k`` (score, job) of each candidate seen so far.

    Jobs are ids, or numbers in the order of their ids. Rows that can no longer make it
    are dropped before they are kept: a row must reach the ``k``-th score its candidate already has.
    """

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k = k
        self.floor = floor
        self.who = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float64)
        self.job: np.ndarray | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting_rows = 0

    def add(self, scores: np.ndarray, jobs: np.ndarray) -> None:
        if scores.shape[1] >= self.k and np.isneginf(self.floor).any():
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.floor = np.maximum(self.floor, np.round(kth, SCORE_PLACES))
        # the margin keeps rows that only reach the floor once rounded
        margin = 10.0**-SCORE_PLACES
        who, at = np.nonzero(scores >= (self.floor - margin)[:, None])
        if not len(who):
            return
        self.waiting.append((who, np.round(scores[who, at], SCORE_PLACES), jobs[at]))
        self.waiting_rows += len(who)
        if self.waiting_rows > max(4 * self.k * len(self.floor), 100_000):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        who = np.concatenate([self.who, *[w[0] for w in self.waiting]])
        score = np.concatenate([self.score, *[w[1] for w in self.waiting]])
        job = np.concatenate([*([] if self.job is None else [self.job]), *[w[2] for w in self.waiting]])
        self.waiting, self.waiting_rows = [], 0
        # code point order, which is how Spark compares strings
        place_of = np.unique(job.astype(str), return_inverse=True)[1] if job.dtype == object else job
        order = np.lexsort((place_of, -score, who))
        who, score, job = who[order], score[order], job[order]
        first = np.searchsorted(who, who, side="left")
        place = np.arange(len(who)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], score[last])
        self.who, self.score, self.job = who[keep], score[keep], job[keep]


def _scan(
    queries: np.ndarray,
    blocks: Iterable[tuple[np.ndarray, np.ndarray]],
    k: int,
    floor: np.ndarray | None = None,
) -> _Best:
    best = _Best(np.full(len(queries), -np.inf) if floor is None else floor, k)
    queries = queries.astype(np.float64)
    step = max(k, SCORES_AT_ONCE // max(1, len(queries)))
    for jobs, vectors in blocks:
        if len(vectors) and len(queries) and vectors.shape[1] != queries.shape[1]:
            raise ValueError(
                f"candidate vectors have {queries.shape[1]} dimensions, "
                f"posting vectors {vectors.shape[1]}"
            )
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            best.add(queries @ vectors[part].astype(np.float64).T, jobs[part])
    best.settle()
    return best


def _result(best: _Best, candidate_ids: pa.Array, job_ids: pa.Array) -> pa.RecordBatch:
    at = np.empty(0, dtype=np.int64) if best.job is None else best.job
    return pa.RecordBatch.from_arrays(
        [candidate_ids.take(pa.array(best.who)), job_ids.take(pa.array(at)), pa.array(best.score, type=pa.float64())],
        names=["candidate_id", "job_id", "score"],
    )


def _hit_schema(candidates: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("candidate_id", candidates.schema["candidate_id"].dataType),
            T.StructField("job_id", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _blocks_of(rows: DataFrame, vector: str, most: float, least: int = 1) -> int:
    """Number of blocks that keeps each below ``most`` bytes."""
    held = rows.agg(F.sum(4 * F.size(vector).cast("bigint"))).first()[0] or 0
    return max(least, math.ceil(held / most))


def _search(some: pa.Table, others: pa.Table, k: int) -> pa.Table:
    """Best ``k`` among ``others`` of each of ``some``."""
    jobs = others.column("job_id").combine_chunks()
    # a job's number is the place of its id in text order
    in_order = pc.array_sort_indices(jobs, null_placement="at_start")
    numbers = np.empty(len(jobs), dtype=np.int64)
    numbers[in_order.to_numpy()] = np.arange(len(jobs))
    jobs, vectors = jobs.take(in_order), _matrix(others.column("embedding"))
    ids, people = some.column("candidate_id").combine_chunks(), _matrix(some.column("resume_embedding"))
    floor = some.column("floor").to_numpy().astype(np.float64)
    floor = np.where(np.isnan(floor), -np.inf, floor)
    step = max(1, KEPT_AT_ONCE // k)
    parts = (slice(start, start + step) for start in range(0, len(people), step))
    return pa.Table.from_batches(
        [_result(_scan(people[part], [(numbers, vectors)], k, floor[part]), ids[part], jobs) for part in parts]
    )


def _meeting(left: DataFrame, right: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Best ``k`` of each candidate in each cell of (block, cell)."""

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return pa.Table.from_batches([], schema=out_schema)
        return _search(some, others, k)

    out_schema = to_arrow_schema(schema)
    return (
        left.groupBy("block", "cell")
        .cogroup(right.groupBy("block", "cell"))
        .applyInArrow(meet, schema)
    )


def best_rows(hits: DataFrame, k: int, pieces: int = 1) -> DataFrame:
    """Rank 1..k per candidate. A first ranking by (candidate, piece) keeps
    any one task small however many partial results a candidate has."""
    order = [F.col("score").desc(), F.col("job_id").asc()]
    if pieces > 1:
        salted = hits.withColumn(
            "piece", F.pmod(F.xxhash64("job_id"), F.lit(pieces)).cast("int")
        )
        by_piece = Window.partitionBy("candidate_id", "piece").orderBy(*order)
        hits = (
            salted.withColumn("place", F.row_number().over(by_piece))
            .where(F.col("place") <= k)
            .drop("piece", "place")
        )
    window = Window.partitionBy("candidate_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def topk_similar(candidates: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar vectors of each candidate, exact.

    candidates: ``candidate_id, resume_embedding`` (other columns ignored)
    vectors:    ``job_id, embedding``
    returns:    ``candidate_id, job_id, score, rank``
    """
    people = candidates.select("candidate_id", "resume_embedding").where(
        F.col("resume_embedding").isNotNull()
    )
    stored = vectors.select("job_id", "embedding").where(F.col("embedding").isNotNull())
    schema = _hit_schema(candidates)
    blocks = _blocks_of(people, "resume_embedding", BLOCK_BYTES / 2)
    # enough cells to use all cores where bytes alone would make fewer
    cores = people.sparkSession.sparkContext.defaultParallelism
    cells = _blocks_of(stored, "embedding", BLOCK_BYTES, max(2, math.ceil(cores / blocks)))
    placed = people.withColumn(
        "block", F.pmod(F.xxhash64(F.col("candidate_id").cast("string")), F.lit(blocks)).cast("int")
    )
    spread = stored.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("job_id"), F.lit(cells)).cast("int").alias("cell"),
        "job_id",
        "embedding",
    )
    first = _meeting(
        placed.select("block", F.lit(0).alias("cell"), "candidate_id", "resume_embedding", F.lit(None).cast("double").alias("floor")),
        spread.where("cell = 0"),
        k,
        schema,
    )
    floors = (
        first.groupBy(F.col("candidate_id").alias("c"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
        .where(F.col("n") >= k)
        .select("c", "floor")
    )
    rest = _meeting(
        placed.join(floors, F.col("candidate_id") == F.col("c"), "left").select(
            "block",
            F.explode(F.sequence(F.lit(1), F.lit(cells - 1))).alias("cell"),
            "candidate_id",
            "resume_embedding",
            "floor",
        ),
        spread.where("cell > 0"),
        k,
        schema,
    )
    return best_rows(first.unionByName(rest), k, math.ceil(cells * k / MERGE_ROWS))


def pair_scores(pairs: DataFrame, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score of given (candidate_id, job_id) pairs, by equi joins only."""
    people = candidates.select("candidate_id", "resume_embedding")
    stored = vectors.select("job_id", "embedding")
    return (
        pairs.select("candidate_id", "job_id")
        .distinct()
        .join(people, "candidate_id")
        .join(stored, "job_id")
        .select(
            "candidate_id",
            "job_id",
            similarity(F.col("resume_embedding"), F.col("embedding")).alias("score"),
        )
    )
