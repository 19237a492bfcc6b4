"""Exact quantiles of any number of rows.

``percentile`` keeps every distinct value in one buffer. Here a sketch first brackets each wanted
position, and only the few values inside the brackets are then counted and put in order. What comes
back to the driver are the quantiles, a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sketches import ERROR, Sketches

# A bracket with more values than this is narrowed before its values are put in order.
CROWDED = 2_000_000


def as_number(name: str) -> Column:
    """The column as a double, with NaN treated as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Per column its quantiles in the order of ``probs``; None for a column without values.

    Linear interpolation between neighbours, missing values left out. Three narrow scans: the values are counted and
    sketched, counted by bracket, and those inside a bracket, a few in a hundred at most, are
    grouped and put in order. Brackets are checked by their counts, so the answer does not hang on the sketch.
    """
    numbers = df.select(*[as_number(c).alias(f"v{i}") for i, c in enumerate(cols)])
    sketches = Sketches(numbers, {f"v{i}": "double" for i in range(len(cols))})
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    known = [i for i in range(len(cols)) if sketches.counts[f"v{i}"]]
    if known:
        for (i, j), value in _from_brackets(numbers, probs, sketches, known).items():
            out[cols[i]][j] = value
    return out


@dataclass
class _Region:
    """Values of column ``col`` from ``lo`` to ``hi``, with the number of values below and inside."""

    col: int
    lo: float
    hi: float
    below: int = 0
    inside: int = 0


def _count(numbers: DataFrame, regions: Sequence[_Region]) -> None:
    """Fill in the counts of the regions, in one scan."""
    row = numbers.agg(
        *[F.count_if(F.col(f"v{r.col}") < r.lo) for r in regions],
        *[F.count_if(F.col(f"v{r.col}").between(r.lo, r.hi)) for r in regions],
    ).first()
    for k, r in enumerate(regions):
        r.below, r.inside = row[k], row[len(regions) + k]


def _narrowed(numbers: DataFrame, r: _Region, places: Sequence[float]) -> _Region:
    """A smaller region that in all likelihood still holds the values at ``places``."""
    name = f"v{r.col}"
    inner = Sketches(numbers.where(F.col(name).between(r.lo, r.hi)).select(name), {name: dict(numbers.dtypes)[name]})
    first = max(0.0, (min(places) - r.below) / r.inside - ERROR)
    last = min(1.0, (max(places) + 1 - r.below) / r.inside + ERROR)
    return _Region(r.col, *inner.quantiles({name: [first, last]})[name])


def _brackets(probs: Sequence[float], sketches: Sketches, known: Sequence[int], wider: int) -> tuple[list[_Region], dict[tuple[int, int], int]]:
    """Regions round the wanted quantiles, and which region is that of quantile j of column i."""
    shares = {}
    for i in known:
        # The error of the sketch, and the two places that a quantile lies between.
        slack = wider * (ERROR + 2.0 / sketches.counts[f"v{i}"])
        shares[f"v{i}"] = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    found = sketches.quantiles(shares)
    regions: list[_Region] = []
    home: dict[tuple[int, int], int] = {}
    for i in known:
        near = found[f"v{i}"]
        for j in sorted(range(len(probs)), key=lambda j: near[2 * j]):
            lo, hi = near[2 * j], near[2 * j + 1]
            # Overlapping brackets become one region.
            if regions and regions[-1].col == i and lo <= regions[-1].hi:
                regions[-1].hi = max(hi, regions[-1].hi)
            else:
                regions.append(_Region(i, lo, hi))
            home[i, j] = len(regions) - 1
    return regions, home


def _holds(r: _Region, places: Sequence[float], n: int) -> bool:
    """Whether the region has the values on both sides of all places."""
    return r.below <= int(min(places)) and min(int(max(places)) + 1, n - 1) < r.below + r.inside


def _settled(
    numbers: DataFrame, probs: Sequence[float], sketches: Sketches, known: Sequence[int], place: Callable[[float, int], float]
) -> tuple[list[_Region], list[tuple[int, int, float]], dict[tuple[int, int], int]]:
    """Regions that hold the values round ``place(prob, n)`` and are small or full of equal values, and what is wanted of them."""
    counts = {i: sketches.counts[f"v{i}"] for i in known}
    wider = 1
    while True:
        regions, home = _brackets(probs, sketches, known, wider)
        wanted = [(i, j, place(probs[j], counts[i])) for i, j in home]
        places = [[at for i, j, at in wanted if home[i, j] == k] for k in range(len(regions))]
        _count(numbers, regions)
        if all(_holds(r, places[k], counts[r.col]) for k, r in enumerate(regions)):
            break
        wider *= 4

    # A crowded region is sketched again until it is small or full of equal values, which grouping
    # folds up before anything is shuffled.
    crowded = {k for k, r in enumerate(regions) if r.inside > CROWDED and r.lo < r.hi}
    while crowded:
        smaller = {k: _narrowed(numbers, regions[k], places[k]) for k in crowded}
        _count(numbers, list(smaller.values()))
        for k, r in smaller.items():
            whole = regions[k].inside
            if _holds(r, places[k], counts[r.col]):
                regions[k] = r
            if regions[k].inside <= CROWDED or r.lo == r.hi or 2 * r.inside > whole:
                crowded.discard(k)
    return regions, wanted, home


@dataclass(frozen=True)
class Selected:
    """The value at a position of a column in order: ``n`` values in all, ``before`` smaller ones, ``ties`` equal ones."""

    n: int
    value: float | int
    before: int
    ties: int


def value_at(df: DataFrame, value: Column, place: Callable[[int], int]) -> Selected | None:
    """Select the value at 0-based position ``place(n)`` without ranking the others; None if there are no values.

    ``value`` is a bigint or a double without NaN; nulls are left out. Three narrow scans as in ``exact_quantiles``.
    """
    numbers = df.select(value.alias("v0"))
    sketches = Sketches(numbers, dict(numbers.dtypes))
    n = sketches.counts["v0"]
    if not n:
        return None
    at = min(max(place(n), 0), n - 1)
    share = at / (n - 1) if n > 1 else 0.0
    (region,), _, _ = _settled(numbers, (share,), sketches, (0,), lambda *_: at)
    inside = numbers.where(F.col("v0").between(region.lo, region.hi)).groupBy("v0").agg(F.count("*").alias("c"))
    placed = inside.withColumn("upto", F.lit(region.below) + F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("v0")))
    found = placed.where((F.col("upto") - F.col("c") <= at) & (F.col("upto") > at)).first()
    return Selected(n, found["v0"], found["upto"] - found["c"], found["c"])


def _from_brackets(numbers: DataFrame, probs: Sequence[float], sketches: Sketches, known: Sequence[int]) -> dict[tuple[int, int], float]:
    """Quantile j of column i from the values in the brackets that the sketch puts around it."""
    counts = {i: sketches.counts[f"v{i}"] for i in known}
    regions, wanted, home = _settled(numbers, probs, sketches, known, lambda p, n: p * (n - 1))
    below = [r.below for r in regions]

    def region_of(i: int) -> Column:
        out = F.lit(None).cast("int")
        for k, r in enumerate(regions):
            if r.col == i:
                out = F.when(F.col(f"v{i}").between(r.lo, r.hi), F.lit(k)).otherwise(out)
        return out

    tagged = numbers.select(
        F.inline(F.array(*[F.struct(region_of(i).alias("r"), F.col(f"v{i}").alias("v")) for i in known]))
    ).where("r is not null")
    counted = tagged.groupBy("r", "v").agg(F.count("*").alias("c"))
    placed = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("r").orderBy("v")))

    def value_in(r: int, place: int) -> Column:
        inside = F.lit(place - below[r])
        mine = (F.col("r") == r) & (F.col("upto") - F.col("c") <= inside) & (inside < F.col("upto"))
        return F.max(F.when(mine, F.col("v")))

    picks = []
    for i, j, place in wanted:
        picks.append(value_in(home[i, j], int(place)))
        picks.append(value_in(home[i, j], min(int(place) + 1, counts[i] - 1)))
    found = placed.agg(*picks).first()
    out = {}
    for k, (i, j, place) in enumerate(wanted):
        lo, hi = found[2 * k], found[2 * k + 1]
        part = place - int(place)
        out[i, j] = lo + (hi - lo) * part if part and lo != hi else lo
    return out
