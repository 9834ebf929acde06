"""Resume to ranked postings, for all candidates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.metadata import bad_work_mode, rebuild
from placewright.operators.compatibility import compatible_jobs, pairs_with_facts, with_metadata
from placewright.operators.keyed import POSTING_READ, metadata_lookup, reduced
from placewright.operators.similarity import topk_similar
from placewright.schemas import METADATA_COLUMNS
from placewright.sources.tables import materialized

PROFILE = (
    "experience_years",
    "must_have_skills",
    "preferred_locations",
    "open_to_relocation",
    "requires_visa_sponsorship",
)


def search_width(top_k: int) -> int:
    """Twice the wanted number, so that the filter has something to drop."""
    return 2 * top_k


def match_resumes(
    candidates: DataFrame,
    vectors: DataFrame,
    postings: DataFrame,
    metadata: DataFrame,
    top_k: int = 10,
    apply_metadata_filtering: bool = True,
) -> DataFrame:
    """Best postings per candidate, best first.

    The order of steps is part of the meaning: the nearest ``2 * top_k``
    *vectors* are taken first; those whose posting is gone and those the
    candidate is not compatible with then free no place for others. Fewer
    than ``top_k`` rows may remain.
    """
    # Read three times below, and the costliest step by far: written once. The
    # rows are few, and a lost executor does not bring the search back.
    hits = materialized(topk_similar(candidates, vectors, search_width(top_k)), "hits")
    return rank_hits(hits, candidates, postings, metadata, top_k, apply_metadata_filtering)


def rank_hits(
    hits: DataFrame,
    candidates: DataFrame,
    postings: DataFrame,
    metadata: DataFrame,
    top_k: int,
    apply_metadata_filtering: bool = True,
) -> DataFrame:
    """Hydrate, filter and re-rank the hits of a similarity search.

    Hits are judged and ranked without texts: requirement rows, profiles and the
    skills found where the postings lie are joined to the narrow hits. Texts are fetched
    last, for the ranked rows only, from postings cut down by a map of their keys.
    """
    found = hits.select("candidate_id", "job_id", "score")
    wanted = metadata_lookup(found, metadata)
    if apply_metadata_filtering:
        people = candidates.select("candidate_id", *PROFILE)
        jobs = compatible_jobs(pairs_with_facts(found, people, postings, wanted))
    else:
        ids = reduced(postings.select("job_id"), "job_id", found.select("job_id"))
        jobs = with_metadata(found, wanted).join(ids, "job_id")
    window = Window.partitionBy("candidate_id").orderBy(
        F.col("score").desc(), F.col("job_id").asc()
    )
    best = jobs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)
    # read for its keys and for its rows
    best = materialized(best.select("candidate_id", "rank", "score", *METADATA_COLUMNS), "best")
    texts = reduced(postings.select(*POSTING_READ), "job_id", best.select("job_id"))
    ranked = best.join(texts, "job_id")
    return ranked.select(
        "candidate_id",
        "rank",
        "job_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company", F.lit("")).alias("company"),
        "location",
        "application_url",
        "description",
        F.col("score").alias("similarity_score"),
        F.lit(True).alias("passed_filters")
        if apply_metadata_filtering
        else F.lit(False).alias("passed_filters"),
        rebuild().alias("metadata"),
        F.when(bad_work_mode(), "work_mode: invalid").alias("metadata_error"),
    )
