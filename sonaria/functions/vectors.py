"""Vector expressions over ``array<float>`` columns, accumulated in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaria.constants import NORM_EPS, SILENT_ATOL, SPEAKER_DIM


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, not once per array item.

    A plain expression inside a lambda is evaluated for every item; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column | str, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    squares = F.aggregate(
        a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")
    )
    return F.sqrt(squares)


def l2_normalise(a: Column) -> Column:
    """x / max(|x|, eps): a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(NORM_EPS))
    return bind(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    scale = F.greatest(norm(a), F.lit(NORM_EPS)) * F.greatest(norm(b), F.lit(NORM_EPS))
    return dot(a, b) / scale


def truncated_cosine(a: Column, b: Column, max_dim: int = SPEAKER_DIM) -> Column:
    """Cosine over the common leading dimensions when the two sizes differ."""
    target = F.least(F.size(a), F.size(b), F.lit(max_dim))
    same = F.size(a) == F.size(b)
    left = F.when(same, a).otherwise(F.slice(a, F.lit(1), target))
    right = F.when(same, b).otherwise(F.slice(b, F.lit(1), target))
    return cosine(left, right)


def finite(a: Column) -> Column:
    """True for a vector that is there and has neither null, NaN nor infinite components."""
    sound = F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False))


def score01(cos: Column) -> Column:
    """Cosine in [-1, 1] to a score in [0, 1]."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)) + 1.0) / 2.0


def is_usable_signal(a: Column, atol: float = SILENT_ATOL) -> Column:
    """False for a signal that is all (nearly) zero or holds NaN or infinity.

    An empty signal counts as all zero; a null one is not usable either.
    """
    wide = F.transform(a, lambda v: v.cast("double"))
    loud = F.exists(wide, lambda v: F.abs(v) > F.lit(atol))
    broken = F.exists(wide, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(loud & ~broken, F.lit(False))
