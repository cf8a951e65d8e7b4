"""Column expressions over arrays of numbers (arithmetic in double)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row, also where it is
    used inside of a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return bound(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def log_sum_exp(v: Column) -> Column:
    return bound(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))))


def softmax(v: Column) -> Column:
    powers = bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return bound(powers, lambda e: bound(total(e), lambda sum_: F.transform(e, lambda x: x / sum_)))


def harmonic(a: Column, b: Column) -> Column:
    """1 / (1/a + 1/b); zero if either is."""
    return F.coalesce(F.try_divide(a * b, a + b), F.lit(0.0))


def fuse_mean(a: Column, b: Column) -> Column:
    return (a + b) / 2


def quantize(score: Column, top: float = 255.0) -> Column:
    """Whole numbers up to ``top``, halves to even."""
    return F.bround(score * top, 0)


def rounded(value: Column | str, digits: int) -> Column:
    """Halves of the scaled double go away from zero, and zero keeps the
    sign of what it is rounded from, as C rounds and so most SQL engines.
    (Spark's ``round`` goes by decimal digits and has no negative zero.)"""
    value, scale = (F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(float(10**digits))
    return F.abs(F.round(value * scale, 0) / scale) * F.signum(value)


def render(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def cast_precision(v: Column) -> Column:
    """Single precision and back (Spark has no half type)."""
    return v.cast("array<float>").cast("array<double>")


def alignment_loss(a: Column, b: Column) -> Column:
    """Squared distance of two mean vectors."""
    return squared_distance(a, b)


def total_loss(main: Column, alignment: Column, weight: float = 0.001) -> Column:
    return main + weight * alignment
