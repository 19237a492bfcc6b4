"""Ranks over a whole table, without bringing the table into one task.

The value range is cut at approximate quantiles. Rows equal to a cut are exactly the candidates
for hot values: their rank follows from bucket counts alone, so they are spread over the tasks.
The rows strictly between two cuts are few by construction and are ordered in a window of their
own. One shuffle of the rows; the only broadcast is the table of bucket counts, whose length is
set by the number of cuts and not by the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hex_number, key_hash
from ..session import shuffle_width, stage
from .quantiles import as_number
from .sketches import Sketches, folded

# Helper columns start with "__rk", to stay clear of the caller's names.

# Hex digits of the hash that say which slice of a hot value a row belongs to.
SLICE_DIGITS = 8


def _cut_count(df: DataFrame) -> int:
    return max(64, 2 * shuffle_width(df.sparkSession))


def rank_value(df: DataFrame, col: str) -> Column:
    """The column in the type it is ranked in: whole numbers as bigint, others as double without NaN."""
    whole = df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(col).cast("bigint") if whole else as_number(col)


def _place(cuts: Column, value: Column, n: int) -> Column:
    """Number of the ``n`` entries of the sorted array ``cuts`` that are below ``value``."""
    steps = []
    step = 1
    while step <= n:
        steps.insert(0, F.lit(step))
        step *= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, s: F.when(F.get(cuts, at + s - 1) < value, at + s).otherwise(at),
    )


def rank_cuts(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[float, int]]:
    """Approximate quantiles of each column in order, found in one scan, and how many of them fall on each value.

    Their number follows the shuffle width, not the data.
    """
    n_cuts = _cut_count(df)
    marks = [(i + 1) / n_cuts for i in range(n_cuts - 1)]
    numbers = df.select(*[rank_value(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    found = Sketches(numbers, dict(numbers.dtypes)).quantiles({name: marks for name in numbers.columns})
    return {c: dict(sorted(Counter(found.get(f"v{i}", ())).items())) for i, c in enumerate(cols)}


@dataclass(frozen=True)
class Rank:
    """Rank ``col`` as ``out``. ``ties``: "average", "min" or "ordinal"."""

    col: str
    out: str
    ties: str = "average"

    def __post_init__(self) -> None:
        if self.ties not in ("average", "min", "ordinal"):
            raise ValueError(f"unknown ties {self.ties!r}")


def add_ranks(
    df: DataFrame,
    ranks: Sequence[Rank],
    by: Sequence[str] = (),
    tie_key: Sequence[str] = (),
    known_groups: int | None = None,
) -> DataFrame:
    """Add for each of ``ranks`` the 1-based rank ``out`` and the number ranked ``<out>_n``.

    Ordinal ranks put equal values in the order of the md5 of ``tie_key``, which should be unique
    per row. Missing values get no rank and are not counted. ``by`` ranks within groups; a caller
    who knows a small bound on the number of groups says so in ``known_groups`` and the bucket
    counts are broadcast if they keep to it, otherwise Spark chooses by their size. Ranking several columns at once
    reads ``df`` fewer times than one after the other.
    """
    by = list(by)
    cuts = rank_cuts(df, sorted({r.col for r in ranks}))
    base = df
    if any(r.ties == "ordinal" for r in ranks):
        # As bytes it sorts like its hex digits and is half as long on the way.
        base = base.withColumn("__rk_h", F.unhex(key_hash(tie_key)))
    # Average and minimum of one column come from the same buckets and the same window.
    shared: dict[tuple[str, bool], list[Rank]] = {}
    for r in ranks:
        shared.setdefault((r.col, r.ties == "ordinal"), []).append(r)
    for i, (col, ordinal) in enumerate(shared):
        base = _with_bucket(base, col, ordinal, i, cuts[col])
    done = base
    for i, (col, ordinal) in enumerate(shared):
        cells = _cells(base, by, i)
        if not by:
            cells = F.broadcast(cells)
        else:
            # Once written its size is known, and Spark broadcasts it only if it is small.
            cells = stage(cells, "cells")
            most = 2 * len(cuts[col]) + 2 + (sum(cuts[col].values()) if ordinal else 0)
            if known_groups is not None and cells.count() <= known_groups * most:
                cells = F.broadcast(cells)
        same = [F.col(c).eqNullSafe(F.col(f"__rk{i}_k{k}")) for k, c in enumerate(by)]
        same += [F.col(f"__rk{i}_b") == F.col(f"__rk{i}_kb"), F.col(f"__rk{i}_p") == F.col(f"__rk{i}_kp")]
        done = done.join(cells, reduce(Column.__and__, same), "left")
    for i, same_buckets in enumerate(shared.values()):
        done = _ranked_in_buckets(done, by, i, same_buckets)
    return done.select(*df.columns, *[c for r in ranks for c in (r.out, f"{r.out}_n")])


def _with_bucket(df: DataFrame, col: str, ordinal: bool, i: int, cuts: dict[float, int]) -> DataFrame:
    """Add value, bucket and slice of the ranks with number ``i``.

    A value that many quantiles fall on has as many slices, so a slice holds about as many rows as any other bucket
    and all slices together are no more than there are quantiles.
    """
    v, at, b, p = (F.col(f"__rk{i}_{x}") for x in ("v", "at", "b", "p"))
    base = df.withColumn(f"__rk{i}_v", rank_value(df, col))
    if cuts:
        edges = folded(list(cuts), dict(base.dtypes)[f"__rk{i}_v"])
        base = base.withColumn(f"__rk{i}_at", _place(edges, v, len(cuts)))
        on_cut = F.coalesce(F.get(edges, at) == v, F.lit(False))
    else:
        base = base.withColumn(f"__rk{i}_at", F.lit(0))
        on_cut = F.lit(False)
    # Even buckets lie between two cuts, odd buckets hold one value, bucket -1 the missing values.
    bucket = F.when(v.isNotNull(), 2 * at + on_cut.cast("int"))
    base = base.withColumn(f"__rk{i}_b", F.coalesce(bucket, F.lit(-1))).drop(f"__rk{i}_at")
    slice_ = F.lit(None).cast("bigint")
    if ordinal and cuts:
        slices = F.get(folded(list(cuts.values()), "bigint"), F.floor(b / 2).cast("int"))
        share = hex_number(F.hex("__rk_h"), SLICE_DIGITS) / F.lit(float(16 ** SLICE_DIGITS))
        slice_ = F.when(b % 2 == 1, F.floor(share * slices))
    return base.withColumn(f"__rk{i}_p", F.coalesce(slice_, F.lit(0).cast("bigint")))


def _cells(base: DataFrame, by: Sequence[str], i: int) -> DataFrame:
    """Per bucket of rank ``i``: its rows, the rows in the buckets before it, and all rows ranked."""
    b, p, c = f"__rk{i}_b", f"__rk{i}_p", f"__rk{i}_c"
    counts = base.groupBy(*by, b, p).agg(F.count(f"__rk{i}_v").alias(c))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = group.orderBy(b, p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        *[F.col(name).alias(f"__rk{i}_k{k}") for k, name in enumerate(by)],
        F.col(b).alias(f"__rk{i}_kb"),
        F.col(p).alias(f"__rk{i}_kp"),
        F.col(c).alias(f"__rk{i}_cc"),
        (F.sum(c).over(running) - F.col(c)).alias(f"__rk{i}_before"),
        F.sum(c).over(group).alias(f"__rk{i}_n"),
    )


def _ranked_in_buckets(df: DataFrame, by: Sequence[str], i: int, ranks: Sequence[Rank]) -> DataFrame:
    """Add the ranks that share buckets: the rows in earlier buckets plus the place within the own bucket."""
    ordinal = ranks[0].ties == "ordinal"
    b, before, wv = (F.col(f"__rk{i}_{x}") for x in ("b", "before", "wv"))
    # Rows that need no window are spread by the number of the task that read them.
    idle = b == -1 if ordinal else b % 2 != 0
    df = df.withColumn(f"__rk{i}_salt", F.when(idle, F.spark_partition_id()).otherwise(F.lit(-1)))
    df = df.withColumn(f"__rk{i}_wv", F.when(~idle, F.col(f"__rk{i}_v")))
    cell = Window.partitionBy(*by, f"__rk{i}_b", f"__rk{i}_p", f"__rk{i}_salt")
    in_order = cell.orderBy(wv, "__rk_h") if ordinal else cell.orderBy(wv)
    # The first and the last place that equal values take.
    first = F.when(idle, F.lit(1)).otherwise(F.rank().over(in_order))
    last = F.when(idle, F.col(f"__rk{i}_cc")).otherwise(F.count("*").over(in_order))
    place = {
        "ordinal": lambda: before + F.row_number().over(in_order),
        "min": lambda: before + first,
        "average": lambda: before.cast("double") + (first + last) / F.lit(2.0),
    }
    added = {}
    for r in ranks:
        added |= {r.out: F.when(b >= 0, place[r.ties]()), f"{r.out}_n": F.col(f"__rk{i}_n")}
    return df.withColumns(added)


def add_rank(
    df: DataFrame,
    col: str,
    out: str,
    ties: str = "average",
    by: Sequence[str] = (),
    tie_key: Sequence[str] = (),
    known_groups: int | None = None,
) -> DataFrame:
    """``add_ranks`` of one column."""
    return add_ranks(df, [Rank(col, out, ties)], by, tie_key, known_groups)


def pct_ranks(
    df: DataFrame,
    ranks: Sequence[Rank],
    by: Sequence[str] = (),
    tie_key: Sequence[str] = (),
    known_groups: int | None = None,
) -> DataFrame:
    """Add percentiles.

    "average": mean rank / n, as in a scored table. "ordinal" and "min": (rank - 1) / (n - 1).
    """
    ranked = add_ranks(df, ranks, by, tie_key, known_groups)
    out = []
    for r in ranks:
        rank, n = F.col(r.out).cast("double"), F.col(f"{r.out}_n")
        out.append((rank / n if r.ties == "average" else F.try_divide(rank - 1, (n - 1).cast("double"))).alias(r.out))
    return ranked.select(*df.columns, *out)


def pct_rank(
    df: DataFrame,
    col: str,
    out: str,
    ties: str = "average",
    by: Sequence[str] = (),
    tie_key: Sequence[str] = (),
    known_groups: int | None = None,
) -> DataFrame:
    """``pct_ranks`` of one column."""
    return pct_ranks(df, [Rank(col, out, ties)], by, tie_key, known_groups)


def position(df: DataFrame, order_col: str, out: str, tie_key: Sequence[str]) -> DataFrame:
    """0-based position of each row in the order of ``order_col``, equal values by ``tie_key``."""
    return add_rank(df, order_col, "__rk_r", "ordinal", tie_key=tie_key).withColumn(out, F.col("__rk_r") - 1).drop("__rk_r", "__rk_r_n")
