"""Numeric expressions: missing values, calibration maps, intervals, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, null for NaN and infinite ones (Spark's aggregates would propagate them)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def numeric(c: Column) -> Column:
    """Coercing cast: what is no number becomes null, also under ANSI mode."""
    return c.try_cast("double")


def port_bucket(port: Column) -> Column:
    p = F.coalesce(port.try_cast("int"), F.lit(-1))
    return F.when(p < 0, "NA").when(p <= 1023, "well_known").when(p <= 49151, "registered").otherwise("ephemeral")


def clipped(p: Column, eps: float = 1e-12) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.ln(q / (1 - q))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null where n = 0."""
    rate = F.try_divide(k, n)
    n_ = F.nullif(n, F.lit(0.0))  # ANSI mode: division by 0 would fail
    mid = (rate + z * z / (2 * n_)) / (1 + z * z / n_)
    half = z * F.sqrt(rate * (1 - rate) / n_ + z * z / (4 * n_ * n_)) / (1 + z * z / n_)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def worst_half_width(n: Column, z: float = 1.959963984540054) -> Column:
    """Half width of the Wilson interval at a rate of one half."""
    return z * F.sqrt(0.25 / n + z * z / (4 * n * n)) / (1 + z * z / n)


def rank_score(benefits: dict[str, float], costs: dict[str, float]) -> Column:
    """Weighted sum of metrics; a missing benefit counts 0, a missing cost 1."""
    total = F.lit(0.0)
    for c, w in benefits.items():
        total = total + w * F.coalesce(numeric(F.col(c)), F.lit(0.0))
    for c, w in costs.items():
        total = total - w * F.coalesce(numeric(F.col(c)), F.lit(1.0))
    return total
