"""Scalar parts of the composite score, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def age_hours(published: Column, snapshot: Column, now: Column) -> Column:
    """Hours from publication to the snapshot, or to ``now`` where the snapshot is undated.

    Exactly 0 becomes 1 and an unknown age becomes 24. Negative ages are kept.
    """
    seen = F.unix_micros(F.coalesce(snapshot.cast("timestamp"), now.cast("timestamp")))
    hours = (seen - F.unix_micros(published.cast("timestamp"))).cast("double") / F.lit(3.6e9)
    return F.coalesce(F.when(hours == 0, F.lit(1.0)).otherwise(hours), F.lit(24.0))


def rate(count: Column, age: Column) -> Column:
    """Count per hour of age."""
    return count.cast("double") / age


def log_rate(x: Column) -> Column:
    """``log(1 + x)`` with negative rates lifted to 0."""
    return F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x))


def rank_score(rank: Column) -> Column:
    """Chart position to (0, 1), first place best; no position counts as place 50."""
    place = F.coalesce(rank.cast("double"), F.lit(50.0))
    return sigmoid(F.lit(6.0) * ((F.lit(1.0) - place / F.lit(50.0)) - F.lit(0.5)))


def recency(age: Column) -> Column:
    """Exponential decay over a day, at most 1."""
    return F.exp(F.least(-age / F.lit(24.0), F.lit(0.0)))


def engagement(likes: Column, views: Column) -> Column:
    """Likes per view to (0, 1); 0 views count as 1."""
    seen = F.when(views == 0, F.lit(1.0)).otherwise(views.cast("double"))
    return sigmoid(F.lit(10.0) * (likes.cast("double") / seen - F.lit(0.05)))


def early(views_n: Column, likes_n: Column) -> Column:
    """Geometric mean of two normalised rates."""
    return F.sqrt(views_n * likes_n)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of weight times column, added in the order of the mapping."""
    total = None
    for name, weight in weights.items():
        term = F.lit(float(weight)) * F.col(name)
        total = term if total is None else total + term
    return total


def with_noise_term(base: Column, u: Column, width: float) -> Column:
    """``base`` plus at most ``width`` of the way to 1, kept within [0, 1]."""
    moved = base + u * F.lit(width) * (F.lit(1.0) - base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))
