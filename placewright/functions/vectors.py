"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.core import let

#: Decimal places kept in a similarity. Sums of products differ in the last
#: bits with the order of addition; rounding makes equal vectors score equal,
#: so that a task that runs again on other batches ranks them the same.
SCORE_PLACES = 9


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def similarity(left: Column, right: Column) -> Column:
    return F.round(dot(left, right), SCORE_PLACES)


def l2_normalize(vector: Column) -> Column:
    """Unit-length float32 vector; a zero vector stays zero."""

    def scaled(norm: Column) -> Column:
        divisor = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return F.transform(vector, lambda x: (x.cast("double") / divisor).cast("float"))

    return let(F.sqrt(dot(vector, vector)), scaled)
