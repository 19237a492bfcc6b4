"""Clipping and spreading of predictions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def soft_clip(x: Column, margin: float = 0.1) -> Column:
    """Smooth map to (0, 1); margins below 0.2 act as 0.2."""
    return F.lit(0.5) + F.lit(0.5) * F.tanh((x - F.lit(0.5)) / F.lit(max(0.2, margin)))


def linear_clip(x: Column, margin: float = 0.05) -> Column:
    """Stretch [margin, 1 - margin] to [0, 1] and cut off the rest."""
    stretched = (x - F.lit(margin)) / F.lit(1 - 2 * margin)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stretched)))


def unit_clip(x: Column) -> Column:
    """Cut to [0, 1]."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clipped(x: Column, how: str | None, margin: float) -> Column:
    """Apply ``how`` = "soft", "linear", "unit" or None."""
    if how is None:
        return x
    return {
        "soft": lambda: soft_clip(x, margin),
        "linear": lambda: linear_clip(x, margin),
        "unit": lambda: unit_clip(x),
    }[how]()
