"""Names of a dictionary of any size in short texts.

Texts and names are cut into words and single other characters. Words of a text that begin a name are found by an equi
join on the name's first word, which also tells how many pieces such names have; the pieces put together are
then joined with the names. So the dictionary is never in one place, and a common first word costs one candidate per
length, not one per name. Equal texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, or one other character.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _without_overlap(found: Column) -> Column:
    """Names from the left, of those that begin at one place the longest, none inside another."""
    ordered = F.array_sort(found)
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("names"))
    taken = F.aggregate(
        ordered,
        start,
        lambda state, hit: F.when(
            hit["at"] >= state["free"],
            F.struct(
                (hit["at"] - hit["shorter"]).alias("free"),
                F.concat(state["names"], F.array(hit["name"])).alias("names"),
            ),
        ).otherwise(state),
    )
    return taken["names"]


def texts_with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``text, found``: the names in each different ``text`` in order of appearance; texts without any are left out.

    ``names`` has a column ``name``. A name stands between ends of the text or characters that are
    no letter or digit next to one; case counts.
    """
    known = names.select("name").where("name <> ''").distinct().withColumn("cut", pieces(F.col("name")))
    heads = known.groupBy(F.element_at("cut", 1).alias("head")).agg(
        # different lengths, a handful
        F.collect_set(F.size("cut")).alias("lengths")
    )
    places = (
        texts.select("text")
        .where("text IS NOT NULL")
        .distinct()
        .withColumn("cut", pieces(F.col("text")))
        .select("text", "cut", F.posexplode("cut").alias("at", "head"))
    )
    asked = (
        places.join(heads, "head")
        .select("text", "at", "cut", F.explode("lengths").alias("length"))
        .where(F.col("at") + F.col("length") <= F.size("cut"))
        .select(
            "text",
            "at",
            "length",
            F.array_join(F.slice("cut", F.col("at") + 1, F.col("length")), "").alias("name"),
        )
    )
    hits = asked.join(known.select("name"), "name", "left_semi")
    # as many as the text has pieces; the negative length puts the longest first
    hit = F.struct("at", (-F.col("length")).alias("shorter"), "name")
    return hits.groupBy("text").agg(_without_overlap(F.collect_list(hit)).alias("found"))


def with_names(rows: DataFrame, text: str, names: DataFrame, out: str) -> DataFrame:
    """``rows`` and a column ``out``: the names in column ``text``, joined by a space; empty if there are none."""
    found = texts_with_names(rows.select(F.col(text).alias("text")), names).select(
        F.col("text").alias("__text"), F.array_join("found", " ").alias("__found")
    )
    joined = rows.join(found, F.col(text) == F.col("__text"), "left")
    value = F.when(F.col(text).isNotNull(), F.coalesce("__found", F.lit("")))
    return joined.withColumn(out, value).drop("__text", "__found")
