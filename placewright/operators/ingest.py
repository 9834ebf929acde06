"""Idempotent loading of ids and postings, clean-up and constraint audit.

Tables are append-only or rewritten by key; "insert or ignore" and "insert or
replace" are expressed as anti joins and rankings. Rankings that keep one row
per key are cut down on each map task before the shuffle, so a key that holds
a large share of all rows costs one row per task, not one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright import schemas

# Title patterns removed by default (lower case, SQL LIKE).
EXCLUDED_TITLES = ("%intern%", "%part%")
CLOSED = "CLOSED"


def new_ids(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append to the id table: ids not seen before, once each."""
    fresh = incoming.select("job_id").where(F.col("job_id").isNotNull()).distinct()
    return fresh.join(known.select("job_id").distinct(), "job_id", "left_anti").withColumn(
        "is_scraped", F.lit(False)
    )


class Ingest(NamedTuple):
    inserted: DataFrame
    rejected: DataFrame
    scraped_ids: DataFrame


def ingest_postings(
    known: DataFrame,
    arrivals: DataFrame,
    order: Sequence[Column],
    required: Sequence[str] = schemas.POSTINGS_NOT_NULL,
) -> Ingest:
    """First complete row per key wins; keys already known are left alone.

    Rows lacking a required value go to ``rejected`` with the column named.
    ``scraped_ids`` are the ids that need no second fetch; an id with nothing
    but rejected rows is not among them.
    """
    gap = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    checked = arrivals.withColumn("missing", gap)
    complete = checked.where(F.col("missing").isNull()).drop("missing")
    # known keys go first: a repeated run then has nothing to rank
    unknown = complete.join(known.select("job_id").distinct(), "job_id", "left_anti")
    return Ingest(
        inserted=latest_rows(unknown, ["job_id"], order),
        rejected=checked.where(F.col("missing").isNotNull()),
        scraped_ids=complete.select("job_id").distinct(),
    )


def latest_rows(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key, whole."""
    window = Window.partitionBy(*key).orderBy(*order)
    return (
        rows.withColumn("place", F.row_number().over(window))
        .where(F.col("place") == 1)
        .drop("place")
    )


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Table content after "insert or replace": the highest ``seq`` wins.

    Only rows whose key arrives again are ranked; the rest of the table, which
    holds each key once, is passed on.
    """
    keys = incoming.select("job_id").distinct()
    again = existing.join(keys, "job_id", "left_semi").unionByName(incoming)
    return existing.join(keys, "job_id", "left_anti").unionByName(
        latest_rows(again, ["job_id"], [F.col(seq).desc()])
    )


class Cleaned(NamedTuple):
    kept: DataFrame
    removed: DataFrame


def exclude_titles(
    postings: DataFrame, patterns: Sequence[str] = EXCLUDED_TITLES
) -> Cleaned:
    """Split off postings whose title is like any pattern.

    A posting without a title is kept. Count ``removed`` for the number of
    deleted rows.
    """
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.lower("title").like(pattern)
    hit = F.coalesce(hit, F.lit(False))
    return Cleaned(postings.where(~hit), postings.where(hit))


def closed_ids(states: DataFrame) -> DataFrame:
    """Ids whose latest landed state (``job_id, seq, state``) is closed, with
    the ``seq`` of that state."""
    return (
        states.groupBy("job_id")
        .agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
        .where(F.col("state") == CLOSED)
        .select("job_id", "seq")
    )


def drop_closed(postings: DataFrame, states: DataFrame) -> DataFrame:
    """Postings whose latest landed state is not closed."""
    return postings.join(closed_ids(states).select("job_id"), "job_id", "left_anti")


def _rule(table: str, rule: str, rows: DataFrame) -> DataFrame:
    """One audit line. ``rows`` carries one ``violations`` number."""
    return rows.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
    )


def _repeats(table: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows beyond the first of each key."""
    counts = table.where(F.col(key).isNotNull()).groupBy(key).count()
    return counts.agg(F.sum(F.col("count") - 1).alias("violations"))


def constraint_audit(
    id_status: DataFrame, postings: DataFrame, metadata: DataFrame, vectors: DataFrame
) -> DataFrame:
    """Violations of each declared rule, zero lines included."""

    def where(table: DataFrame, broken: Column) -> DataFrame:
        return table.agg(F.count_if(broken).alias("violations"))

    # each key once: the right side of an anti join is never split
    keys = postings.select("job_id").distinct()

    def orphans(table: DataFrame) -> DataFrame:
        return table.join(keys, "job_id", "left_anti").agg(
            F.count("*").alias("violations")
        )

    lines = [
        _rule("id_status", "job_id unique", _repeats(id_status)),
        _rule(
            "id_status", "is_scraped not null", where(id_status, F.col("is_scraped").isNull())
        ),
        _rule("postings", "job_id unique", _repeats(postings)),
    ]
    # one pass over the postings for all of their NOT NULL rules
    gaps = postings.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in schemas.POSTINGS_NOT_NULL]
    )
    unpivoted = gaps.unpivot(
        [], list(schemas.POSTINGS_NOT_NULL), "column_name", "violations"
    )
    lines.append(
        unpivoted.select(
            F.lit("postings").alias("table_name"),
            F.concat("column_name", F.lit(" not null")).alias("rule"),
            F.col("violations").cast("long").alias("violations"),
        )
    )
    lines += [
        _rule("metadata", "job_id unique", _repeats(metadata)),
        _rule("metadata", "job_id references postings", orphans(metadata)),
        _rule("vectors", "job_id references postings", orphans(vectors)),
    ]
    audit = lines[0]
    for line in lines[1:]:
        audit = audit.unionByName(line)
    return audit
