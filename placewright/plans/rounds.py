"""Model extraction in rounds: ask, validate, ask again with what was wrong.

A round is a table. The rows whose reply broke a rule go into the next round with the very errors that validation
named; what passed is left alone. Each round is written before the next one begins, so a lost executor repeats
calls of its own round only, and nothing is asked twice because a later step failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.prompts import DEFAULT_TEMPLATE, build_prompt
from placewright.functions.text import has_text
from placewright.operators.enrich import Extractor, flatten_metadata, validate_replies
from placewright.operators.inference import EXTRACTION_ATTEMPTS, RETRY_NOTE, Loaded, Model
from placewright.sources.buckets import BucketTable
from placewright.sources.tables import materialized

#: What became of every attempted posting of every batch.
LEDGER = "job_id STRING, batch BIGINT, attempts INT, outcome STRING, reason STRING"


def _ask(waiting: DataFrame, held: Loaded) -> DataFrame:
    """``job_id, prompt, reply, failure``: one call per row; a failing call is a failed attempt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.get()
        for batch in batches:
            replies, failures = [], []
            for prompt, error in zip(batch["prompt"], batch["error"]):
                try:
                    replies.append(model(prompt + (RETRY_NOTE % error if error else "")))
                    failures.append(None)
                except Exception as problem:  # the next round tells the model
                    replies.append(None)
                    failures.append(str(problem) or type(problem).__name__)
            yield batch[["job_id", "prompt"]].assign(reply=replies, failure=failures)

    return waiting.mapInPandas(run, "job_id string, prompt string, reply string, failure string")


def model_rounds(
    postings: DataFrame,
    model_loader: Callable[[], Model],
    attempts: int = EXTRACTION_ATTEMPTS,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """``job_id, attempt, metadata, error`` of every attempt on ``job_id, description``.

    ``error`` is what validation, or the failing call, said; the last attempt of a posting
    is its result. Ids should be unique: rows that share one are asked together each round.
    """
    held = Loaded(model_loader)
    waiting = postings.where(has_text(F.col("description"))).select(
        "job_id", build_prompt(F.col("description"), template).alias("prompt"), F.lit(None).cast("string").alias("error")
    )
    rounds = []
    for attempt in range(1, attempts + 1):
        asked = _ask(waiting, held)
        checked = validate_replies(asked, keep=("job_id", "prompt", "failure"))
        told = F.coalesce("failure", F.when(F.size("errors") > 0, F.array_join("errors", "; ")))
        ok = told.isNull()
        state = checked.select(
            "job_id", F.lit(attempt).alias("attempt"), F.when(ok, F.col("metadata")).alias("metadata"),
            told.alias("error"), F.when(~ok, F.col("prompt")).alias("prompt"),
        )
        done = materialized(state, f"round-{attempt}")
        rounds.append(done.drop("prompt"))
        waiting = done.where("error IS NOT NULL").select("job_id", "prompt", "error")
        if attempt < attempts and waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def last_attempts(rounds: DataFrame) -> DataFrame:
    """The result of every posting: its last attempt."""
    last = F.max_by(F.struct("attempt", "metadata", "error"), "attempt").alias("last")
    return rounds.groupBy("job_id").agg(last).select("job_id", "last.*")


def model_extractor(
    model_loader: Callable[[], Model], attempts: int = EXTRACTION_ATTEMPTS, template: str = DEFAULT_TEMPLATE
) -> Extractor:
    """A model as an extractor, wherever the rules can stand."""

    def extract(postings: DataFrame) -> DataFrame:
        rounds = model_rounds(postings, model_loader, attempts, template)
        return last_attempts(rounds).select("job_id", "metadata", "error")

    return extract


class ModelBatch(NamedTuple):
    metadata: DataFrame
    ledger: DataFrame


def run_model_batch(
    postings: DataFrame,
    metadata: BucketTable,
    ledger: BucketTable,
    batch_id: int,
    model_loader: Callable[[], Model],
    attempts: int = EXTRACTION_ATTEMPTS,
    template: str = DEFAULT_TEMPLATE,
) -> ModelBatch:
    """Extract what the table lacks, append it, and enter every outcome in the ledger.

    Postings that still fail stay pending for the next batch. A batch that is
    repeated asks again and replaces what it wrote.
    """
    pending = metadata.missing(postings.select("job_id", "description"), before=2 * batch_id)
    results = materialized(last_attempts(model_rounds(pending, model_loader, attempts, template)), "results")
    ok = F.col("metadata").isNotNull()
    ledger.append(
        results.select(
            "job_id", F.lit(batch_id).cast("long").alias("batch"), F.col("attempt").alias("attempts"),
            F.when(ok, "processed").otherwise("failed").alias("outcome"), F.when(~ok, F.col("error")).alias("reason"),
        ),
        batch_id,
    )
    # the table last: a crash between the two leaves the postings pending
    metadata.append(flatten_metadata(results.where(ok)).select(*schemas.METADATA_COLUMNS), batch_id)
    return ModelBatch(metadata.read(), ledger.read())
