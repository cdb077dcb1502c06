"""Vector arithmetic as SQL expressions (checks and pairwise values; search is blocked)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: (x.cast("double") / size).cast("float"))


def is_unit(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - F.lit(1.0)) <= F.lit(tolerance)


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` literal to a float array; NULL when it does not parse."""
    return F.from_json(text, "array<float>")
