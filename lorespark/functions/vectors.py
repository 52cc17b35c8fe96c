"""Vector expressions. All are JVM-side and in double precision; vectors are arrays of float or double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A constant vector."""
    return F.lit([float(x) for x in vector])


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of the two lengths."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(as_double(a), 1, n), F.slice(as_double(b), 1, n), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def l2_score(a: Column, b: Column) -> Column:
    """``1 / (1 + distance)``."""
    return 1.0 / (1.0 + l2_distance(a, b))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def int8(v: Column) -> Column:
    """``round(127 x)`` held within -127 and 127."""
    return F.transform(as_double(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127.0))))


def sign_bits(v: Column, width: int = 32) -> Column:
    """One bit per component (1: not negative), in words of ``width`` bits."""
    n = F.size(v)
    words = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(F.slice(as_double(v), (w * width + 1).cast("int"), width), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
