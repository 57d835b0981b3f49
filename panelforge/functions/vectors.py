"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding(col: Column, kind: str) -> Column:
    """array<double> from an array or JSON text; NULL for blank, broken or empty values."""
    values = F.from_json(col, "array<double>") if kind == "string" else F.transform(col, lambda x: x.cast("double"))
    return F.when(F.size(values) > 0, values)


def norm(v: Column) -> Column:
    """Euclidean length, summed from the left in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different length are an error."""
    checked = F.when(F.size(a) == F.size(b), a).otherwise(
        F.raise_error(F.lit("vectors of different length")).cast("array<double>")
    )
    product = F.zip_with(checked, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where either vector has no length. Norms can be given if they are at hand."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
