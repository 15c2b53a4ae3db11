"""Vector expressions on ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are rounded to this many digits before ordering, so that ties do not
#: depend on summation order or on how a pool was sliced.
SCORE_DIGITS = 9
MISSING_SCORE = -1.0


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: zero vector -> 0, missing or empty vector -> -1."""
    lengths = norm(a) * norm(b)
    value = F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)
    missing = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.round(F.when(missing, F.lit(MISSING_SCORE)).otherwise(value), SCORE_DIGITS)
