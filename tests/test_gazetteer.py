"""Names of a table in texts, against a plain search."""

import random
import re

from pyspark.sql import functions as F

from placewright.operators.gazetteer import texts_with_names, with_names
from placewright.sources.payloads import parse_posting_details


def plain(text, names):
    """Leftmost, longest, not inside a word."""
    out, at = [], 0
    while at < len(text):
        inside = at > 0 and text[at - 1].isalnum()
        best = ""
        for name in names:
            if text.startswith(name, at) and len(name) > len(best):
                end = at + len(name)
                if not (inside and name[0].isalnum()) and not (end < len(text) and text[end].isalnum() and name[-1].isalnum()):
                    best = name
        if best:
            out.append(best)
            at += len(best)
        else:
            at += 1
    return " ".join(out)


NAMES = ["New York", "New", "York", "New York Mills", "Guinea", "Guinea-Bissau", "Côte d'Ivoire", "Åland", "San José", "St. Gallen", "Mills-on-Sea"]


def test_names_equal_a_plain_search(spark):
    draw = random.Random(4)
    words = [*NAMES, "Newton", "in", "St.", "d'Ivoire", "york"]
    texts = ["", "New York", "New York Mills-on-Sea", "xNew York", None]
    texts += ["".join(draw.choice(words) + draw.choice([" ", ", ", "-", "/", ""]) for _ in range(draw.randint(1, 7))) for _ in range(200)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, place string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "New", "", None]], "name string")
    got = {r.k: r.found for r in with_names(rows, "place", names, "found").collect()}
    assert got == {k: None if t is None else plain(t, NAMES) for k, t in enumerate(texts)}


def test_many_names_with_one_first_word(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("San "), F.col("id").cast("string")).alias("name"))
    texts = spark.createDataFrame([("San 7, San 999999 and San 1000000",), ("Santa 7",)], "text string")
    assert [(r.text, r.found) for r in texts_with_names(texts, names).collect()] == [
        ("San 7, San 999999 and San 1000000", ["San 7", "San 999999"])
    ]


def test_payloads_take_a_table_of_names(spark):
    payload = (
        '{"data":{"description":{"text":"d"},"title":"t","formattedLocation":"Graz, Styria, Austria",'
        '"originalListedAt":1700000000000,"companyDetails":{"companyName":"c"}}}'
    )
    rows = spark.createDataFrame([("1", payload)], "job_id string, payload string")
    names = spark.createDataFrame([("Austria",), ("Styria",)], "name string")
    got = parse_posting_details(rows, names).postings.first()
    want = parse_posting_details(rows, ["Austria", "Styria"]).postings.first()
    assert got == want and got.country == "Styria Austria"
