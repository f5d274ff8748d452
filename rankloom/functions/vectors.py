"""Vector functions.  Vectors are ARRAY<FLOAT>; sums are taken in DOUBLE."""

from pyspark.sql import functions as F


def settle(score, digits):
    """Round a score before it is ranked, so that equal scores tie on any plan."""
    return score if digits is None else F.round(score, digits)


def dot(a, b):
    """Dot product of two arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def similarity(a, b, kind="dot"):
    """``dot``, or ``dot01`` = (1 + dot) / 2, the affine form for unit vectors."""
    raw = dot(a, b)
    if kind == "dot":
        return raw
    if kind == "dot01":
        return (F.lit(1.0) + raw) / 2
    raise ValueError(f"unknown similarity: {kind}")


def mean_vector(name, width):
    """Aggregate: the element-wise mean of a vector column of one width.

    One ``avg`` per element keeps the aggregation in generated code with
    map-side partial sums; nothing is exploded.
    """
    return F.expr("array(" + ", ".join(f"avg(`{name}`[{i}])" for i in range(width)) + ")")
