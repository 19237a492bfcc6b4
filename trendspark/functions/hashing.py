"""Keyed pseudo-random numbers.

Every draw is a function of a seed and the row's key, so results do not depend on the order or
the partitioning of the rows and can be recomputed after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def key_hash(key: Sequence[str] | str, seed: int | str = 42) -> Column:
    """32 hex digits of md5 over ``seed|key``; null key parts count as empty text."""
    names = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hex_number(digest: Column, digits: int) -> Column:
    """The first ``digits`` hex digits (at most 15) as a bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def uniform(key: Sequence[str] | str, seed: int | str = 42) -> Column:
    """A double in [0, 1) that depends on seed and key only."""
    return hex_number(key_hash(key, seed), 8).cast("double") / F.lit(4294967296.0)
