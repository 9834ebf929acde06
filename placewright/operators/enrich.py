"""Requirement extraction over tables: rules, validation, gap filling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions import metadata as meta
from placewright.functions import rules, validation
from placewright.functions.core import computed_once
from placewright.functions.text import has_text, strip_fences

#: (job_id, description) -> (job_id, metadata, error); one row per input row.
Extractor = Callable[[DataFrame], DataFrame]


def extract_requirements(postings: DataFrame) -> DataFrame:
    """Rule extraction: ``job_id, metadata, error`` (error always NULL)."""
    ruled = computed_once(cut_sentences(postings), "metadata", rules.requirements(F.col("parts")))
    return ruled.select("job_id", "metadata", F.lit(None).cast("string").alias("error"))


def cut_sentences(postings: DataFrame) -> DataFrame:
    """``job_id, parts``: what the rules read of each posting."""
    parts = rules.sentences(F.col("description"))
    return computed_once(postings.select("job_id", "description"), "parts", parts).select(
        "job_id", "parts"
    )


def validate_replies(replies: DataFrame, keep: Sequence[str] = ("job_id",)) -> DataFrame:
    """``reply`` and the ``keep`` columns -> those, ``metadata, errors``; metadata
    is NULL when any rule is broken."""
    bare = F.try_parse_json(strip_fences(F.col("reply")))
    parsed = computed_once(replies, "root", bare).select(*keep, "root")
    looked_up = computed_once(parsed, "probe", validation.probes(F.col("root")))
    checked = computed_once(
        looked_up.select(*keep, "probe"), "errors", validation.errors(F.col("probe"))
    )
    return checked.select(
        *keep,
        F.when(F.size("errors") == 0, validation.read(F.col("probe"))).alias("metadata"),
        "errors",
    )


def flatten_metadata(nested: DataFrame) -> DataFrame:
    """``job_id, metadata`` -> the flat requirement row."""
    flat = meta.flatten(F.col("metadata"))
    return nested.select("job_id", *[col.alias(name) for name, col in flat.items()])


def rebuild_metadata(flat: DataFrame) -> DataFrame:
    """The flat row -> ``job_id, metadata``."""
    return flat.select("job_id", meta.rebuild().alias("metadata"))


def enrich_gaps(
    matches: DataFrame, extract: Extractor = extract_requirements
) -> DataFrame:
    """Fill missing metadata of matches from their own text.

    Only rows without metadata but with a description are extracted, each
    posting once however many candidates it matched. A failed extraction
    leaves NULL; no row is lost.
    """
    gaps = matches.where(F.col("metadata").isNull() & has_text(F.col("description")))
    texts = gaps.groupBy("job_id").agg(F.first("description").alias("description"))
    found = extract(texts).select("job_id", F.col("metadata").alias("extracted"))
    stored = F.col("metadata").isNotNull()
    return (
        matches.join(found, "job_id", "left")
        .withColumn(
            "metadata_from",
            F.when(stored, "stored").when(F.col("extracted").isNotNull(), "extracted"),
        )
        .withColumn("metadata", F.coalesce("metadata", "extracted"))
        .drop("extracted")
    )


def evidence_grounding(nested: DataFrame, postings: DataFrame) -> DataFrame:
    """Every stated evidence, and whether it is a verbatim part of the text."""
    stated = nested.where(F.col("metadata").isNotNull()).select(
        "job_id", F.explode(meta.evidence_pairs(F.col("metadata"))).alias("pair")
    )
    return stated.join(postings.select("job_id", "description"), "job_id").select(
        "job_id",
        F.col("pair.field").alias("field"),
        F.col("pair.evidence").alias("evidence"),
        F.contains("description", F.col("pair.evidence")).alias("grounded"),
    )


def _loose(evidence: Column) -> Column:
    """Pattern of a text in which any white space stands for any other."""
    literal = F.regexp_replace(F.trim(evidence), r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.regexp_replace(literal, r"\s+", r"\\s+")


def evidence_spans(nested: DataFrame, postings: DataFrame) -> DataFrame:
    """``job_id, field, evidence, start, stop``: where each stated evidence stands in the text.

    Line breaks and repeated blanks do not matter, so a quote that a model has
    put on one line is found as well; ``substring(description, start + 1, stop - start)`` is
    the text's own wording. Both are NULL where the evidence is not in the text.
    """
    stated = nested.where(F.col("metadata").isNotNull()).select(
        "job_id", F.explode(meta.evidence_pairs(F.col("metadata"))).alias("pair")
    )
    found = stated.join(postings.select("job_id", "description"), "job_id").select(
        "job_id",
        F.col("pair.field").alias("field"),
        F.col("pair.evidence").alias("evidence"),
        F.regexp_instr("description", _loose(F.col("pair.evidence"))).alias("place"),
        F.regexp_substr("description", _loose(F.col("pair.evidence"))).alias("wording"),
    )
    start = F.when((F.col("place") > 0) & (F.trim("evidence") != ""), F.col("place") - 1)
    return found.select(
        "job_id", "field", "evidence", start.alias("start"), (start + F.length("wording")).alias("stop")
    )


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """``job_id, metadata, errors`` -> ``job_id, outcome, reason``."""
    ok = F.col("metadata").isNotNull()
    return attempts.select(
        "job_id",
        F.when(ok, "processed").otherwise("failed").alias("outcome"),
        F.when(~ok, F.array_join("errors", "; ")).alias("reason"),
    )

