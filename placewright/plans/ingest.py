"""Landed payloads to postings, requirement rows and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright import schemas
from placewright.operators.enrich import (
    Extractor,
    attempt_outcomes,
    extract_requirements,
    flatten_metadata,
)
from placewright.operators.inference import Encoder, embed_postings
from placewright.operators.ingest import (
    EXCLUDED_TITLES,
    Ingest,
    exclude_titles,
    ingest_postings,
)
from placewright.operators.keyed import pending
from placewright.sources.payloads import parse_posting_details
from placewright.sources.tables import materialized, read_table, write_batch


class Loaded(NamedTuple):
    postings: DataFrame
    excluded: DataFrame
    ingest: Ingest
    unreadable: DataFrame


def load_details(
    payloads: DataFrame,
    known: DataFrame,
    countries: list[str] | DataFrame,
    order: Sequence[Column],
    patterns: Sequence[str] = EXCLUDED_TITLES,
) -> Loaded:
    """Parse, insert-or-ignore, then drop unwanted titles."""
    parsed = parse_posting_details(payloads, countries)
    result = ingest_postings(known, parsed.postings, order)
    cleaned = exclude_titles(result.inserted, patterns)
    return Loaded(cleaned.kept, cleaned.removed, result, parsed.rejected)


def extract_pending(
    postings: DataFrame, metadata: DataFrame, extract: Extractor = extract_requirements
) -> tuple[DataFrame, DataFrame]:
    """(new flat rows, outcome per attempted posting).

    Postings that fail get no flat row, so the next run tries them again.
    """
    attempts = extract(pending(postings, metadata))
    done = flatten_metadata(attempts.where("metadata IS NOT NULL"))
    return done, attempts


def run_extract_batch(
    spark: SparkSession,
    postings: DataFrame,
    table: str,
    batch_id: int,
    extract: Extractor = extract_requirements,
    outcomes: str | None = None,
) -> DataFrame:
    """Extract what the metadata table lacks, append it, return the table.

    A batch that is repeated replaces itself; a further batch finds nothing
    left to do but the failures. With ``outcomes`` that table keeps what became
    of each attempted posting: ``job_id, outcome, reason``.
    """
    stored = read_table(spark, table, schemas.METADATA, before_batch=batch_id)
    if outcomes is None:
        fresh, _ = extract_pending(postings, stored, extract)
    else:
        # read for the rows and for the outcomes; an extractor may be costly
        attempts = materialized(extract(pending(postings, stored)), "attempts")
        ok = F.col("metadata").isNotNull()
        told = attempts.select(
            "job_id", F.when(ok, "processed").otherwise("failed").alias("outcome"), F.when(~ok, F.col("error")).alias("reason")
        )
        write_batch(told, outcomes, batch_id)
        fresh = flatten_metadata(attempts.where(ok))
    write_batch(fresh, table, batch_id)
    return read_table(spark, table, schemas.METADATA).drop("batch_id")


def run_embed_batch(
    spark: SparkSession,
    postings: DataFrame,
    table: str,
    batch_id: int,
    loader: Callable[[], Encoder],
) -> DataFrame:
    """Embed postings without a vector, append them, return the table."""
    stored = read_table(spark, table, schemas.VECTORS, before_batch=batch_id)
    write_batch(embed_postings(pending(postings, stored), loader), table, batch_id)
    return read_table(spark, table, schemas.VECTORS).drop("batch_id")


__all__ = [
    "Loaded",
    "attempt_outcomes",
    "extract_pending",
    "load_details",
    "run_embed_batch",
    "run_extract_batch",
]
