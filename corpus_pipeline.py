"""From raw documents to token ids, one written table per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import bpe, mixing, near_dup, quality, queries, secret_scan
from placewright.llm.common import Stored, without


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier finds junk or abusive go. Words of abuse are learnt with ``labels``, if there are any."""
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return quality.keep_clean(docs, labels=labels)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id.

    Rows that repeat a kept id all stay, and so do rows without an id.
    """
    dropped = near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return without(docs, "doc_id", dropped)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the new text."""
    clean = secret_scan.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: files and rows follow its slots.

    A reader that stops anywhere before a source runs out has every source's target share. The next stage carries
    the order on as a column.
    """
    slots = (
        mixing.mix(docs)
        .groupBy(F.col("doc_id").alias("mixed_id"))
        .agg(F.min(F.struct("slot", "place")).alias("mixed_at"))
    )
    return (
        docs.join(slots, docs["doc_id"].eqNullSafe(slots["mixed_id"]))
        .repartitionByRange(slots["mixed_at"], docs["doc_id"])
        .sortWithinPartitions(slots["mixed_at"], docs["doc_id"])
        .select(*(docs[c] for c in docs.columns))
    )


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` read from files with ``__place``, which grows with the rows in the order they were written.

    It is made of the numbers in the file's name (part, then piece) and of the row's number in the file, so nothing is counted,
    joined or moved. NULL for rows that come from no file.
    """
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return docs.withColumn("__place", F.lit(None).cast("long"))
    name = F.col("_metadata.file_name")
    part, piece = (
        F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
        for pattern in (r"part-(\d+)", r"-c(\d+)")
    )
    return docs.select(*docs.columns, (F.shiftleft(part, 40) + F.shiftleft(piece, 30) + F.col("_metadata.row_index")).alias("__place"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of what they decode to.

    ``mix_position`` orders the documents as the mix does; its values leave gaps between files.
    """
    return bpe.round_trip(placed(docs), queries.rank_file(), ["doc_id", "source", "__place"], with_ids=True).withColumnRenamed(
        "__place", "mix_position"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_clean),
    ("near duplicates", deduplicate),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: Weak labels, sketches and merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = Stored(spark, "corpus-pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
