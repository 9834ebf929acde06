import pytest
from pyspark.sql import functions as F

from placewright.functions import text as t
from placewright.functions.prompts import build_prompt, draft_prompt, review_prompt
from placewright.functions.vectors import l2_normalize, similarity
from placewright.sources.payloads import country_names, gazetteer_names


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("\n oak\t elm  ash ", "oak elm ash"),
        ("a  b　", "a b"),
        ("\x1c a\x85b \t", "a b"),
        ("plain text", "plain text"),
        (" \n ", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, t.clean_text) == want
    assert one(spark, raw, t.clean_text) == " ".join(raw.split())


def test_time_and_ids(spark):
    got = one(spark, 0, lambda x: F.date_format(t.local_time(x), "yyyy-MM-dd HH:mm"), "bigint")
    assert got == "1970-01-01 05:30"
    assert one(spark, "urn:li:x:(42,SEARCH)", t.urn_id) == "42"
    assert one(spark, "no brackets", t.urn_id) is None


@pytest.mark.parametrize("raw, want", [("```json\n{}\n```", "{}"), (" {} ", "{}"), ("```x```", "x")])
def test_strip_fences(spark, raw, want):
    assert one(spark, raw, t.strip_fences) == want


@pytest.mark.parametrize(
    "raw, want",
    [("true", True), (" Yes ", True), ("1", True), ("y", True), ("false", False), ("", False), (None, False)],
)
def test_as_bool(spark, raw, want):
    assert one(spark, raw, t.as_bool) is want


@pytest.mark.parametrize(
    "raw, want", [("y", True), (" APPROVE ", True), ("apply", True), ("no", False), ("", False), (None, False)]
)
def test_approval(spark, raw, want):
    assert one(spark, raw, t.is_approval) is want


@pytest.mark.parametrize(
    "raw, want", [("python, sql", ["python", "sql"]), (" , ,a,", ["a"]), ("", []), (None, [])]
)
def test_csv_list(spark, raw, want):
    assert one(spark, raw, t.csv_list) == want


def test_first_three(spark):
    assert one(spark, ["", "a", None, "b", "c", "d"], t.first_non_empty, "array<string>") == ["a", "b", "c"]


def test_countries_in_order_of_appearance(spark):
    names = gazetteer_names(country_names(spark))
    assert {"Germany", "India"} <= set(names)
    found = one(spark, "Pune, India / Berlin, Germany, Guinea-Bissau", lambda x: t.names_in_text(x, names))
    assert found == "India Germany Guinea-Bissau"
    assert one(spark, "Nowhere", lambda x: t.names_in_text(x, names)) == ""


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    got = frame.select(
        l2_normalize(F.col("a")), l2_normalize(F.col("z")), similarity(F.col("a"), F.col("a"))
    ).first()
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8]
    assert got[1] == [0.0, 0.0] and got[2] == 25.0


def test_prompts(spark):
    assert one(spark, "TEXT {x}", lambda x: build_prompt(x, "A {output_json} B {job_description}")).endswith("B TEXT {x}")
    body = one(spark, "D", lambda x: draft_prompt(x, F.lit("R")))
    assert body == "JOB DESCRIPTION:\nD\n\nRESUME:\nR"
    review = one(spark, "D", lambda x: review_prompt(F.lit("K"), F.lit("T"), x, F.lit("R")))
    assert review == "DOCUMENT TYPE: K\n\nORIGINAL RESUME:\nR\n\nJOB DESCRIPTION:\nD\n\nDRAFT:\nT"
