"""Helpers to have a value computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, not wherever it occurs.

    Needed inside lambdas over arrays, where an outer expression would be
    evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def computed_once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections will not repeat.

    The optimizer writes a projected expression out again in every filter
    pushed below it. A one-element ``explode`` is a border it does not cross.
    """
    return frame.select("*", F.explode(F.array(value)).alias(name))
