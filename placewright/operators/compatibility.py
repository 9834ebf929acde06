"""Compatibility filter and its funnel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright import schemas
from placewright.functions.predicates import RULES, compatibility
from placewright.operators import keyed
from placewright.operators.skills import has_all, number_skills, skill_index, with_needs


_TYPES = dict(part.split() for part in schemas.METADATA.split(", "))


def with_metadata(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of the flat requirement row; none gives NULL facts."""
    missing = [c for c in schemas.METADATA_COLUMNS if c not in metadata.columns]
    facts = metadata
    for name in missing:
        facts = facts.withColumn(name, F.lit(None).cast(_TYPES[name]))
    return jobs.join(facts.select(*schemas.METADATA_COLUMNS), "job_id", "left")


def pairs_with_facts(
    pairs: DataFrame, people: DataFrame, postings: DataFrame, metadata: DataFrame
) -> DataFrame:
    """All that the rules read of (candidate, job) pairs, without a text.

    Skills are found in each text where it lies and become ``skills_met``; pairs
    whose posting or candidate is gone vanish.
    """
    numbered = number_skills(people)
    places = [c for c in ("location", "country") if c in postings.columns]
    # only postings of a pair are read for skills
    wanted = keyed.reduced(postings, "job_id", pairs.select("job_id"))
    index = skill_index(wanted, numbered, ("job_id", *places))
    rows = pairs.join(with_needs(people, numbered), "candidate_id").join(index, "job_id")
    return with_metadata(
        rows.withColumn("skills_met", has_all(F.col("found"), F.col("needs"))).drop("found", "needs"), metadata
    )


def _rules(jobs: DataFrame, prefs: Mapping[str, Column] | None) -> dict[str, Column]:
    met = F.col("skills_met") if "skills_met" in jobs.columns else None
    return compatibility(prefs, met)


def verdicts(
    jobs: DataFrame, prefs: Mapping[str, Column] | None = None
) -> DataFrame:
    """The row plus one ``ok_<rule>`` flag per rule and ``is_compatible``."""
    rules = _rules(jobs, prefs)
    flagged = jobs.select("*", *[rules[r].alias(f"ok_{r}") for r in RULES])
    everything = F.lit(True)
    for rule in RULES:
        everything = everything & F.col(f"ok_{rule}")
    return flagged.withColumn("is_compatible", everything)


def compatible_jobs(
    jobs: DataFrame, prefs: Mapping[str, Column] | None = None
) -> DataFrame:
    """Keep the rows all rules keep. Column names as in ``compatibility``."""
    condition = F.lit(True)
    for rule in _rules(jobs, prefs).values():
        condition = condition & rule
    return jobs.where(condition)


def filter_funnel(jobs: DataFrame, prefs: Mapping[str, Column] | None = None) -> DataFrame:
    """Per candidate: rows in, kept, dropped, and dropped by each rule.

    A row that breaks two rules counts for both.
    """
    flags = verdicts(jobs, prefs)
    return flags.groupBy("candidate_id").agg(
        F.count("*").alias("jobs_in"),
        F.count_if("is_compatible").alias("jobs_kept"),
        F.count_if(~F.col("is_compatible")).alias("jobs_dropped"),
        *[F.count_if(~F.col(f"ok_{r}")).alias(f"dropped_{r}") for r in RULES],
    )
