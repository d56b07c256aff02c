"""Vector expressions over ``array<float>`` or ``array<double>``, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; null if an operand is null or the lengths differ."""
    a, b = _c(a), _c(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine; smaller is more alike. Null where a vector has no direction."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance; null if an operand is null or the lengths differ."""
    a, b = _c(a), _c(b)
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def check_length(a: str | Column, n: int) -> Column:
    """The vector itself; an error for a vector of another length, as there is no fixed-size type."""
    return F.when(_c(a).isNull() | (F.size(_c(a)) == n), _c(a)).otherwise(F.raise_error(F.lit(f"expected a vector of {n} numbers")))
