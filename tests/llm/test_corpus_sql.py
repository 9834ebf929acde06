"""Corpus queries that SQL can express, against their SQL."""

import pytest

from oracle_check import DATA, duck, rows_of
from placewright.llm.queries import ORACLE_SQL, QUERIES

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = rows_of(QUERIES[name](spark, f"{DATA}/{SF}").toArrow())
    want = rows_of(duck(SF).execute(ORACLE_SQL[name]).to_arrow_table())
    assert got == want
