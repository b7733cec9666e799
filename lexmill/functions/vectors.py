"""Arithmetic on array<float|double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a) -> Column:
    """Length one; a zero vector stays zero."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(_col(a), lambda x: x.cast("double") / n)


def softmax(logits) -> Column:
    z = _col(logits)
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(values) -> Column:
    """0-based position of the first largest value."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
