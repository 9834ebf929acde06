"""Fixtures of the corpus tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import rows  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, kept boolean, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """``kept`` and ``size`` are columns that operators also make."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
