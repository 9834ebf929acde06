"""Candidates from whole text files or from a table of texts."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from placewright.session import mounted_path

# Defaults of a run.
DEFAULT_TOP_K = 5
DEFAULT_YEARS = 3
#: Files of one shelf: a text takes few bytes but some milliseconds to write, so
#: tasks are cut by files, not by bytes.
FILES_A_SHELF = 250
#: Spark lists the folders below a root in parallel only where there are more than 32.
LEAST_SHELVES = 64


def _folder_name(key: str, value: str | None) -> str:
    """``key=value`` as ``partitionBy`` spells it."""
    if not value:
        return f"{key}=__HIVE_DEFAULT_PARTITION__"
    return f"{key}=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def _to_files(root: str, key: str) -> Callable[[Iterator[Row]], None]:
    """Writes rows sorted by shelf and key; a file is whole as soon as it has its name."""

    def write(rows: Iterator[Row]) -> None:
        for (shelf, name), lines in groupby(rows, lambda row: (row["shelf"], _folder_name(key, row[key]))):
            folder = os.path.join(root, f"shelf={shelf}", name)
            os.makedirs(folder, exist_ok=True)
            started = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(started, "wb") as file:
                for row in lines:
                    file.write((row["value"] or b"") + b"\n")
            os.replace(started, os.path.join(folder, "part.txt"))

    return write


def write_texts(texts: DataFrame, folder: str, key: str) -> None:
    """A file ``shelf=<n>/<key>=<key's value>/...`` per key; ``texts``: the key and ``value``.

    Each shelf is written by one task and listed by one task. On a mounted file system tasks open the files
    themselves: Hadoop's client may start two processes (``chmod``) for each file there.
    """
    shelves = max(LEAST_SHELVES, math.ceil(texts.count() / FILES_A_SHELF))
    shelved = texts.withColumn("shelf", F.pmod(F.xxhash64(key), F.lit(shelves))).repartition(shelves, "shelf")
    root = mounted_path(texts.sparkSession, folder)
    if root is None:
        shelved.write.partitionBy("shelf", key).text(folder)
    else:
        plain = shelved.select("shelf", F.col(key).cast("string"), F.col("value").cast("binary"))
        os.makedirs(root, exist_ok=True)  # read back even if there is no text
        plain.sortWithinPartitions("shelf", key).foreachPartition(_to_files(root, key))


def with_default_profile(resumes: DataFrame, experience_years: int = DEFAULT_YEARS) -> DataFrame:
    """``candidate_id, resume_text`` with an open profile."""
    no_names = F.array().cast("array<string>")
    return resumes.select(
        "candidate_id",
        "resume_text",
        F.lit(experience_years).alias("experience_years"),
        no_names.alias("must_have_skills"),
        no_names.alias("preferred_locations"),
        F.lit(False).alias("open_to_relocation"),
        F.lit(False).alias("requires_visa_sponsorship"),
    )


def load_candidates(
    spark: SparkSession, paths: str | list[str], id_pattern: str = r"([^/]+)$"
) -> DataFrame:
    """One candidate per text file, read whole.

    ``id_pattern`` has one group that picks the candidate id from the path,
    which is decoded first: a blank is a blank, not ``%20``.
    """
    # a plus sign is itself in a path
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_extract(path, id_pattern, 1).alias("candidate_id"),
        F.col("value").alias("resume_text"),
    )
    return with_default_profile(files)
