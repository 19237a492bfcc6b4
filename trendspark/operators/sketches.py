"""Quantile sketches of whole columns, merged in levels.

Each task sketches its own rows; FAN sketches at a time are then merged into one, so no task ever reads more than FAN
of them, however many tasks there are. A sketch takes about 20 bytes times K, whatever it has seen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

K = 4096
# A quantile of a sketch of this size is off by more than this share of the rows once in far over a hundred times.
ERROR = 0.002
FAN = 64
LEVELS = 3  # FAN ** LEVELS tasks are met by merges of FAN; beyond that the last merge reads more

_SKETCH = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}
_MERGE = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}
_COUNT = {"bigint": F.kll_sketch_get_n_bigint, "double": F.kll_sketch_get_n_double}
_QUANTILE = {"bigint": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}


def folded(numbers: Sequence[float | int], kind: str) -> Column:
    """A constant array as one literal of the plan, however long it is."""
    if not numbers:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def levelled(numbers: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row with a sketch per column of ``kinds`` (bigint or double), from one scan. Nulls and NaN are left out."""
    level = numbers.select(*kinds, F.spark_partition_id().alias("__task"))
    for depth in range(LEVELS - 1):
        work = _MERGE if depth else _SKETCH
        level = level.groupBy(F.expr(f"__task div {FAN}").cast("int").alias("__task")).agg(
            *[work[kind](c, F.lit(K)).alias(c) for c, kind in kinds.items()]
        )
    return level.agg(*[_MERGE[kind](c, F.lit(K)).alias(c) for c, kind in kinds.items()])


class Sketches:
    """The sketches of some columns, fetched once: counts and quantiles of the same sketch as often as needed."""

    def __init__(self, numbers: DataFrame, kinds: Mapping[str, str]):
        self.kinds = dict(kinds)
        self.spark = numbers.sparkSession
        top = levelled(numbers, self.kinds)
        seen = top.select(*self.kinds, *[_COUNT[kind](c).alias(f"{c}__n") for c, kind in self.kinds.items()]).first()
        self.counts: dict[str, int] = {c: seen[f"{c}__n"] or 0 for c in self.kinds}
        self._sketches = {c: bytes(seen[c]) for c in self.kinds if self.counts[c]}

    def quantiles(self, wanted: Mapping[str, Sequence[float]]) -> dict[str, list]:
        """Per column with values the approximate quantiles at the given shares, in their order."""
        asked = {c: list(shares) for c, shares in wanted.items() if self.counts[c] and shares}
        if not asked:
            return {}
        names = list(asked)
        row = self.spark.createDataFrame(
            [tuple(bytearray(self._sketches[c]) for c in names)], ", ".join(f"`{c}` binary" for c in names)
        )
        got = row.select(*[_QUANTILE[self.kinds[c]](c, folded(asked[c], "double")).alias(c) for c in names]).first()
        return {c: list(got[c]) for c in names}
