"""Keyed reads and pending sets.

Key sets are DataFrames. How they are joined is left to the adaptive optimizer,
which picks the strategy from the bytes it sees at run time. The big table is
reduced to the wanted keys before it meets wide rows, so that a text is moved
at most once, not once per hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING_READ = (
    "job_id",
    "title",
    "company",
    "description",
    "location",
    "country",
    "application_url",
)
#: The matching step reads all requirement columns but the language text.
METADATA_READ = (
    "job_id",
    "min_experience_years",
    "experience_requirement_text",
    "requires_only_english",
    "requires_advanced_degree",
    "education_requirement_text",
    "visa_sponsorship_available",
    "relocation_assistance_provided",
    "work_mode",
    "relocation_evidence",
)


#: Bits of the map that tells which rows can be wanted: 8 MB, whatever the input.
WANTED_BITS = 1 << 26


def reduced(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (one column).

    A bit map of hashed keys is held by every task, so other rows end where they are
    read. A few pass by chance: the caller's join on the key tells.
    """
    name = wanted.columns[0]

    def place(column: str) -> tuple[Column, Column]:
        spot = F.pmod(F.xxhash64(column), F.lit(WANTED_BITS)) + 1
        return F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)

    bucket, position = place(name)
    maps = (
        wanted.where(F.col(name).isNotNull())
        .select(bucket.alias("__bucket"), position.alias("__position"))
        .groupBy("__bucket")
        .agg(F.bitmap_construct_agg("__position").alias("__bits"))
    )
    bucket, position = place(key)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # the map has WANTED_BITS at most
    joined = rows.join(F.broadcast(maps), bucket == F.col("__bucket"))
    return joined.where(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(
        *(rows[c] for c in rows.columns)
    )


def hydrate(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Posting columns for every hit; hits without a posting vanish."""
    wanted = [c for c in POSTING_READ if c in postings.columns]
    named = postings.select(*wanted).join(hits.select("job_id").distinct(), "job_id", "left_semi")
    return named.join(hits, "job_id")


def metadata_lookup(keys: DataFrame, metadata: DataFrame) -> DataFrame:
    """Requirement rows of the given keys; unknown keys are absent."""
    return metadata.select(*METADATA_READ).join(
        keys.select("job_id").distinct(), "job_id", "left_semi"
    )


def pending(rows: DataFrame, done: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def processing_state(
    discovered: DataFrame, postings: DataFrame, metadata: DataFrame, vectors: DataFrame
) -> DataFrame:
    """How far each discovered id has come, derived from the tables.

    Nothing is updated in place: a stage is done for an id when its table has
    a row for it. All joins share the key, so each table is shuffled once.
    """
    state = discovered.select("job_id").distinct()
    for table, flag in (
        (postings, "is_scraped"),
        (metadata, "is_processed"),
        (vectors, "is_embedded"),
    ):
        done = table.select("job_id").distinct().withColumn(flag, F.lit(True))
        state = state.join(done, "job_id", "left").withColumn(
            flag, F.coalesce(F.col(flag), F.lit(False))
        )
    return state
