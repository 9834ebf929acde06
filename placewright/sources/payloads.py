"""Landed JSON payloads: search pages and posting details.

Payloads arrive as one JSON text per row (a text file, a message value, a
table column). Parsing is ``from_json`` with the fields that are read, so the
rest of a payload is skipped. Rows that cannot be used are kept apart.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.core import computed_once
from placewright.functions.text import (
    clean_text,
    has_text,
    local_time,
    names_in_text,
    urn_id,
)
from placewright.operators.gazetteer import with_names

# Names inside the payloads.
CARD_TYPE = "JobCard"
COMPANY_TYPE = "com.linkedin.voyager.organization.Company"

SEARCH_PAGE = (
    "data STRUCT<paging: STRUCT<total: BIGINT>, elements: ARRAY<STRUCT<"
    "`$type`: STRING, jobCardUnion: STRUCT<`*jobPostingCard`: STRING>>>>"
)
DETAIL = (
    "data STRUCT<description: STRUCT<text: STRING>, title: STRING, "
    "formattedLocation: STRING, originalListedAt: BIGINT, jobState: STRING, "
    "applyMethod: STRUCT<companyApplyUrl: STRING, easyApplyUrl: STRING>, "
    "companyDetails: STRUCT<companyName: STRING>>, "
    "included ARRAY<STRUCT<`$type`: STRING, name: STRING>>"
)
#: Most names that become part of one pattern; larger gazetteers stay tables.
GAZETTEER_LIMIT = 2_000


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file line: ``payload, source_file``."""
    return spark.read.text(path).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_file")
    )


def parse_search_pages(pages: DataFrame) -> DataFrame:
    """``page_no, payload`` -> ``page_no, total, job_id`` of the posting cards."""
    parsed = computed_once(pages, "page", F.from_json("payload", SEARCH_PAGE))
    cards = parsed.select(
        "page_no",
        F.col("page.data.paging.total").alias("total"),
        F.explode("page.data.elements").alias("card"),
    )
    return cards.where(F.contains(F.col("card")["$type"], F.lit(CARD_TYPE))).select(
        "page_no",
        "total",
        urn_id(F.col("card")["jobCardUnion"]["*jobPostingCard"]).alias("job_id"),
    ).where(F.col("job_id").isNotNull())


def rejected_search_pages(pages: DataFrame) -> DataFrame:
    """``page_no, reason, payload`` of pages that are not readable or hold a
    posting card without an id."""
    parsed = computed_once(pages, "page", F.from_json("payload", SEARCH_PAGE))
    nameless = F.exists(
        "page.data.elements",
        lambda card: F.contains(card["$type"], F.lit(CARD_TYPE))
        & urn_id(card["jobCardUnion"]["*jobPostingCard"]).isNull(),
    )
    reason = F.when(F.col("page.data").isNull(), "not readable").when(nameless, "card without id")
    return parsed.select("page_no", reason.alias("reason"), "payload").where(F.col("reason").isNotNull())


class Parsed(NamedTuple):
    postings: DataFrame
    rejected: DataFrame


def gazetteer_names(gazetteer: DataFrame) -> list[str]:
    """The ``name`` column as a list, after a check that it is small."""
    rows = gazetteer.select("name").distinct().limit(GAZETTEER_LIMIT + 1).collect()
    if len(rows) > GAZETTEER_LIMIT:
        raise ValueError(f"a gazetteer may hold {GAZETTEER_LIMIT} names at most")
    return sorted(row["name"] for row in rows)


def country_names(spark: SparkSession) -> DataFrame:
    """Country names the JVM knows for the ISO codes, as a gazetteer."""
    locale = spark.sparkContext._jvm.java.util.Locale
    names = [
        locale("", code).getDisplayCountry(locale.ENGLISH)
        for code in locale.getISOCountries()
    ]
    return spark.createDataFrame([(name,) for name in names], "name string")


def parse_posting_details(payloads: DataFrame, countries: list[str] | DataFrame) -> Parsed:
    """``job_id, payload`` -> posting rows, and rows that cannot be used.

    ``countries``: a few names as a list, or a table of any size with a column ``name``.
    """
    parsed = computed_once(
        payloads.select("job_id", "payload"), "doc", F.from_json("payload", DETAIL)
    )
    data = F.col("doc.data")
    named = F.filter(
        F.col("doc.included"), lambda entity: entity["$type"] == COMPANY_TYPE
    )
    reason = (
        F.when(data.isNull(), "not readable")
        .when(data["description"]["text"].isNull(), "no description")
        .when(data["title"].isNull(), "no title")
        .when(data["formattedLocation"].isNull(), "no location")
        .when(data["originalListedAt"].isNull(), "no listing time")
    )
    judged = parsed.withColumn("reason", reason)
    postings = judged.where(F.col("reason").isNull()).select(
        "job_id",
        data["title"].alias("title"),
        F.coalesce(
            data["companyDetails"]["companyName"],
            F.try_element_at(named, F.lit(1))["name"],
        ).alias("company"),
        clean_text(data["description"]["text"]).alias("description"),
        data["formattedLocation"].alias("location"),
        local_time(data["originalListedAt"]).alias("posted_at"),
        F.coalesce(
            F.nullif(data["applyMethod"]["companyApplyUrl"], F.lit("")),
            data["applyMethod"]["easyApplyUrl"],
            F.lit(""),
        ).alias("application_url"),
        *(
            [names_in_text(data["formattedLocation"], countries).alias("country")]
            if isinstance(countries, list)
            else []
        ),
    )
    if not isinstance(countries, list):
        postings = with_names(postings, "location", countries, "country")
    rejected = judged.where(F.col("reason").isNotNull()).select(
        "job_id", "reason", "payload"
    )
    return Parsed(postings, rejected)


def posting_states(payloads: DataFrame) -> DataFrame:
    """``job_id, seq, payload`` -> ``job_id, seq, state`` of landed details."""
    state = F.get_json_object("payload", "$.data.jobState")
    landed = computed_once(payloads, "state", state)
    return landed.select("job_id", "seq", "state").where(has_text(F.col("state")))
