"""Keyed sampling, capping, splitting and re-weighting.

"The first n in the order of a keyed hash" is a random sample that does not depend on how rows are
ordered or partitioned. To take it, only a cut-off hash per group is looked for: a histogram over
hash prefixes finds the slice the cut-off lies in, and only that slice is put in order. The rows
themselves are then filtered where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.hashing import hex_number, key_hash, uniform
from ..schema import BALANCE_EDGES
from ..session import shuffle_width, stage
from .profile import bin_index
from .quantiles import value_at
from .rank import rank_value

# Sorts after every hash: a group with this cut-off is kept whole.
KEEP_ALL = "g"

# Rows wanted of a group, from its rows and the rows of all groups.
Quota = Callable[[int, int], int]


# A slice with more rows than this is cut by further digits of the hash before it is put in order.
SLICE_ROWS = 1_000_000


def _prefix_digits(df: DataFrame) -> int:
    """Hex digits that cut the rows into at least eight slices per shuffle partition, 4,096 at the least."""
    return max(3, ceil(log(8 * shuffle_width(df.sparkSession), 16)))


def _cut_offs(
    df: DataFrame, group: Column, quota: Quota, key: Sequence[str], seed: int | str
) -> dict[int | None, str]:
    """Per group the highest hash that is still within the quota.

    The number of groups must be small and known (bins, or one). Narrow scans of ``df``: one
    counts the rows per hash prefix, further ones read on where the cut-offs lie, with longer prefixes as long as
    a slice is too large to be put in order at once.
    """
    digits = _prefix_digits(df)
    hashed = df.select(group.alias("g"), key_hash(key, seed).alias("h"))
    sliced = hashed.withColumn("s", F.substring("h", 1, digits))
    # At most 16 ** digits rows per group.
    slices = stage(sliced.groupBy("g", "s").agg(F.count("*").alias("c")), "slices")
    totals = {r["g"]: r["n"] for r in slices.groupBy("g").agg(F.sum("c").alias("n")).collect()}
    n = sum(totals.values())
    wanted = {g: quota(total, n) for g, total in totals.items()}
    cuts = {g: KEEP_ALL if q >= totals[g] else "" for g, q in wanted.items()}

    def for_group(values: dict[int | None, int], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for g, value in values.items():
            out = F.when(F.col("g").eqNullSafe(F.lit(g)), F.lit(value)).otherwise(out)
        return out

    inner = {g: q for g, q in wanted.items() if 0 < q < totals[g]}
    if not inner:
        return cuts
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("s"))

    def edges_of(counts: DataFrame, places: dict[int | None, int]) -> list[Row]:
        """Per group the slice that its wanted place lies in, and the place within the slice."""
        counted = counts.withColumn("upto", upto).withColumn("q", for_group(places, "bigint"))
        return counted.where("upto - c < q and q <= upto").selectExpr("g", "s", "c", "q - upto + c as place").collect()

    def inside(edges: Sequence[Row]) -> Column:
        near = F.lit(False)
        for r in edges:
            near = near | (F.col("g").eqNullSafe(F.lit(r["g"])) & F.col("h").startswith(r["s"]))
        return near

    edges, length = edges_of(slices, inner), digits
    while length < 32 and any(r["c"] > SLICE_ROWS for r in edges):
        length += digits
        finer = hashed.where(inside(edges)).groupBy("g", F.substring("h", 1, length).alias("s")).agg(F.count("*").alias("c"))
        edges = edges_of(finer, {r["g"]: r["place"] for r in edges})
    placed = hashed.where(inside(edges)).withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h")))
    ends = placed.where(F.col("rn") == for_group({r["g"]: r["place"] for r in edges}, "bigint")).collect()
    cuts.update({r["g"]: r["h"] for r in ends})
    return cuts


def _one_cut(df: DataFrame, quota: Quota, key: Sequence[str], seed: int | str) -> Column:
    return F.lit(_cut_offs(df, F.lit(0), quota, key, seed).get(0, KEEP_ALL))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int | str = 42) -> DataFrame:
    """``n`` random rows without replacement, all rows if there are fewer. ``key`` is unique per row."""
    return df.where(key_hash(key, seed) <= _one_cut(df, lambda total, _: n, key, seed))


def cap_groups(
    df: DataFrame, group: Column, quota: Quota, key: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """At most ``quota(rows of the group, rows of all groups)`` random rows per group.

    Rows of the null group are dropped. For groups whose number is small and known.
    """
    limit = F.lit(None).cast("string")
    for g, cut in _cut_offs(df, group, quota, key, seed).items():
        if g is not None:
            limit = F.when(group == F.lit(g), F.lit(cut)).otherwise(limit)
    return df.where(key_hash(key, seed) <= limit)


def stratified_cap(
    df: DataFrame, col: str, edges: Sequence[float], n: int, key: Sequence[str], seed: int | str = 42,
    closed: str = "right",
) -> DataFrame:
    """At most ``n`` random rows per bin of ``col``; rows outside all bins are dropped."""
    return cap_groups(df, bin_index(F.col(col), edges, closed), lambda total, _: n, key, seed)


def rebalance(
    df: DataFrame, col: str, key: Sequence[str], seed: int | str = 42, edges: Sequence[float] = BALANCE_EDGES,
    dominant: float = 0.15, cap: int = 8000, at_least: int = 2000,
) -> DataFrame:
    """Thin out crowded bins.

    A bin with more than the share ``dominant`` of all rows is cut to that share. Other bins keep
    up to ``cap`` rows, and no fewer than ``at_least`` where they have them. Rows outside all bins
    count in the total and are dropped.
    """

    def quota(total: int, n: int) -> int:
        if total > n * dominant:
            return int(n * dominant)
        return max(min(total, cap), at_least)

    return cap_groups(df, bin_index(F.col(col), edges, "left"), quota, key, seed)


def bin_noise(
    df: DataFrame, col: str, key: Sequence[str], seed: int | str = 42, edges: Sequence[float] = BALANCE_EDGES
) -> DataFrame:
    """Move each score by up to 15 to 30 % of the width of its bin, to break up clusters.

    Scores near 0.2 only move down. Results stay in [0, 1], and those that sit on a 4-digit value
    are nudged off it. Scores outside all bins stay.
    """
    value = F.col(col)
    at = bin_index(value, edges, "left")
    widths = F.array(*[F.lit(float(b) - float(a)) for a, b in zip(edges, edges[1:])])
    scale = F.get(widths, at) * (F.lit(0.15) + uniform(key, f"{seed}a") * F.lit(0.15))
    u = uniform(key, f"{seed}b")
    down_only = (value > 0.199) & (value < 0.201)
    shift = F.when(down_only, -u * scale).otherwise((u - F.lit(0.5)) * scale * F.lit(2.0))
    moved = df.withColumn("_m", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value + shift)))
    sits = F.abs(F.col("_m") - F.round("_m", 4)) < 0.0001
    nudged = F.when(sits, F.col("_m") + uniform(key, f"{seed}c") * F.lit(0.0001)).otherwise(F.col("_m"))
    return moved.withColumn(col, F.when(at.isNotNull(), nudged).otherwise(value)).drop("_m")


def train_test_split(
    df: DataFrame, test: float, key: Sequence[str], seed: int | str = 42, exact: bool = True, out: str = "split"
) -> DataFrame:
    """Label rows "test" or "train".

    ``exact`` puts ceil(test * n) rows into the test set and wants a ``key`` unique per row. Without
    it each key goes to the test set with probability ``test``; with a key shared by several rows
    (a title, a video) they stay together.
    """
    if exact:
        cut = _one_cut(df, lambda total, _: ceil(total * test), key, seed)
        in_test = key_hash(key, seed) <= cut
    else:
        in_test = uniform(key, seed) < test
    return df.withColumn(out, F.when(in_test, F.lit("test")).otherwise(F.lit("train")))


def tail_holdout(
    df: DataFrame, frac: float, order_col: str, tie_key: Sequence[str], out: str = "holdout"
) -> DataFrame:
    """Mark the rows from position floor(n * (1 - frac)) on, in the order of ``order_col``, equal values by the hash of ``tie_key``.

    Only the value at that position and, among rows of that value, the hash of the last one before it are looked for; the rows are
    marked where they are. Rows without a value get no mark.
    """
    value = rank_value(df, order_col)
    found = value_at(df, value, lambda n: floor(n * (1 - frac)))
    if found is None:
        return df.withColumn(out, F.lit(None).cast("boolean"))
    start = floor(found.n * (1 - frac))
    if start >= found.n:
        return df.withColumn(out, F.when(value.isNotNull(), F.lit(False)))
    edge = F.lit(found.value)
    first = max(start, 0) - found.before
    tied = F.lit(True)
    if first > 0:
        cut = _one_cut(df.where(value == edge), lambda total, _: first, tie_key, 42)
        tied = key_hash(tie_key) > cut
    return df.withColumn(out, F.when(value > edge, True).when(value == edge, tied).when(value < edge, False))


def inverse_freq_weight(df: DataFrame, col: str, out: str = "weight", default: str = "unknown") -> DataFrame:
    """Weight 1 / (rows of the same value + 1); a missing value counts as ``default``.

    The counts are written first: Spark then knows their size and broadcasts them only if small.
    """
    value = F.coalesce(F.col(col), F.lit(default))
    counts = stage(df.groupBy(value.alias("_value")).agg(F.count("*").alias("_count")), "counts")
    joined = df.join(counts, value == F.col("_value"), "left")
    return joined.withColumn(out, F.lit(1.0) / (F.col("_count") + 1)).drop("_value", "_count")


def _line_units(df: DataFrame, weight: str) -> Column:
    """The length of a row's stretch: its share of 2^58 units, at least one, null without a positive weight.

    The weights are first summed as whole numbers relative to the largest, so the total does not
    depend on the order of the rows; two short passes over one column.
    """
    value = F.col(weight).cast("double")
    usable = (value > 0) & ~F.isnan(value)
    n, most = df.where(usable).agg(F.count("*"), F.max(value)).first()
    if not n or most == float("inf"):
        raise ValueError(f"{weight} holds no positive finite total")
    unit = float(1 << 58 - (n - 1).bit_length())
    whole = F.greatest(F.lit(1).cast("bigint"), F.floor(value / F.lit(most) * F.lit(unit)).cast("bigint"))
    total = df.where(usable).agg(F.sum(whole)).first()[0]
    share = value / F.lit(most) * F.lit(unit) / F.lit(float(total)) * F.lit(float(1 << 58))
    return F.when(usable, F.greatest(F.lit(1).cast("bigint"), F.floor(share).cast("bigint")))


def weighted_resample(
    df: DataFrame, weight: str, n: int | None, key: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """Draw ``n`` rows (None: as many as there are) with replacement, in proportion to ``weight``.

    Each row owns a stretch of a line of about 2^58 units, as long as its share of all weight and at
    least one unit if its weight is positive; rows of other weights (zero, negative, null, NaN) are never drawn.
    Without a positive weight, or with an infinite one, nothing can be drawn and a ValueError is raised.
    Each draw is a keyed point on the line, taken from 60 bits without favouring a part of it. The line is cut into slots of equal length; a row's stretch is
    handed to every slot it reaches, so even a row that is drawn very often is met in many tasks.
    Within a slot the row of a draw is the last stretch that begins at or before it. All this is done with hashes and lengths
    alone; the rows, whose ``key`` is unique, meet the draws that hit them in one join at the end. The result has
    the name of the draw in ``draw`` and the columns of ``df``.
    """
    digits = _prefix_digits(df)
    slots = max(64, 4 * shuffle_width(df.sparkSession))
    lined = (
        df.select(key_hash(key, seed).alias("_h"), _line_units(df, weight).alias("_w"))
        .where("_w > 0")
        .withColumn("_c", F.substring("_h", 1, digits))
    )
    sums = lined.groupBy("_c").agg(F.sum("_w").alias("_cw"))
    offsets = sums.select(
        F.col("_c").alias("_oc"),
        (F.sum("_cw").over(Window.partitionBy(F.lit(0)).orderBy("_c")) - F.col("_cw")).alias("_off"),
    )
    whole = lined.agg(F.sum("_w").alias("w")).scalar()
    slot_len = F.ceil(whole.cast("double") / F.lit(float(slots)))

    # One row per hash prefix, so the broadcast side is bounded by the number of prefixes.
    placed = lined.join(F.broadcast(offsets), F.col("_c") == F.col("_oc"))
    upto = F.sum("_w").over(Window.partitionBy("_c").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_hi", F.col("_off") + upto).withColumn("_lo", F.col("_hi") - F.col("_w"))
    placed = placed.withColumn("_len", slot_len)
    reached = F.sequence(F.expr("_lo div _len"), F.expr("(_hi - 1) div _len"))
    owned = placed.withColumn("_slot", F.explode(reached)).select(
        "_slot",
        F.greatest(F.col("_lo"), F.col("_slot") * F.col("_len")).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("string").alias("draw"),
        F.col("_h").alias("_row"),
    )
    if n is None:
        names = df.select(key_hash(key, f"{seed}n").alias("draw"))
    else:
        names = df.sparkSession.range(n).select(F.col("id").cast("string").alias("draw"))
    bits = hex_number(F.md5(F.concat_ws("|", F.lit(f"{seed}draw"), F.col("draw"))), 15)
    product = bits.cast("decimal(19,0)") * whole.cast("decimal(19,0)")
    spot = F.call_function("div", product, F.lit(1 << 60).cast("decimal(19,0)")).cast("bigint")
    drawn = (
        names.withColumn("_at", spot)
        .withColumn("_len", slot_len)
        .select(
            F.expr("_at div _len").alias("_slot"),
            "_at",
            F.lit(1).alias("_kind"),
            "draw",
            F.lit(None).cast("string").alias("_row"),
        )
    )
    line = Window.partitionBy("_slot").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = owned.unionByName(drawn).withColumn("_hit", F.last("_row", ignorenulls=True).over(line))
    hits = met.where("_kind = 1").select("draw", "_hit")
    return hits.join(df.withColumn("_hit", key_hash(key, seed)), "_hit").select("draw", *df.columns)
