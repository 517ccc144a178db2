"""Expressions over arrays of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(p: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top2_margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return F.when(F.size(p) < 2, 1.0).otherwise(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def entropy(p: Column) -> Column:
    """Entropy divided by that of the uniform distribution; 0 for fewer than two classes."""
    sum_ = total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-12)))))
    return F.when(F.size(p) <= 1, 0.0).otherwise(-sum_ / F.ln(F.size(p).cast("double")))


def normalised(p: Column, eps: float = 0.0) -> Column:
    """Clipped at eps and divided by the sum; rows without mass become uniform."""
    q = F.transform(p, lambda x: F.greatest(x, F.lit(eps)))
    s = total(q)
    return F.when(s > 0, F.transform(q, lambda x: x / s)).otherwise(F.transform(q, lambda x: F.lit(1.0) / F.size(p)))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(z)
    return normalised(F.transform(z, lambda x: F.exp((x - top) / F.lit(temperature))))


def tempered(p: Column, temperature: float) -> Column:
    """Softmax of ln p / T; T = 1 only normalises."""
    if abs(temperature - 1) < 1e-12:
        return normalised(p, 1e-12)
    return softmax(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-12)))), temperature)


def biased(p: Column, multipliers: list[float]) -> Column:
    m = F.array(*[F.lit(float(x)) for x in multipliers])
    return normalised(F.zip_with(p, m, lambda x, y: x * y))


def known_brier(p: Column, truth: Column) -> Column:
    """Sum of squares + 1 - 2 * probability of the true class (index from 0)."""
    return total(F.transform(p, lambda x: x * x)) + 1 - 2 * F.get(p, truth)
