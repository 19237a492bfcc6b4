"""Blending of model predictions and the search for blend weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import combinations
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clipping import clipped
from ..session import stage
from .evaluate import average_rank_corr, safe_corr, spearman
from .rank import Rank, add_rank, pct_rank, pct_ranks


CELL_ROWS = 250_000  # rows of a cell, about: what one task sorts at a time
SAMPLE_ROWS = 20_000
MOST_CELLS = 10_000


def _mix(cols: Sequence[str], weights: Sequence[Column]) -> Column:
    total = None
    for c, w in zip(cols, weights):
        term = w * F.col(c)
        total = term if total is None else total + term
    return total


def blend(
    df: DataFrame, cols: Sequence[str], weights: Sequence[float], out: str = "blend", rank: bool = False,
    tie_key: Sequence[str] = (), clip: str | None = None, margin: float = 0.1,
) -> DataFrame:
    """Weighted mean of prediction columns; the weights are scaled to sum to 1.

    ``rank`` first replaces each column by its ordinal percentile.
    """
    whole = float(sum(weights))
    used = list(cols)
    ranked = df
    if rank:
        used = [f"_rank_{c}" for c in cols]
        ranked = pct_ranks(df, [Rank(c, r, "ordinal") for c, r in zip(cols, used)], tie_key=tie_key)
    mixed = clipped(_mix(used, [F.lit(float(w) / whole) for w in weights]), clip, margin)
    return ranked.select(*df.columns, mixed.alias(out))


def _search(
    df: DataFrame, cols: Sequence[str], y: str, weights: Sequence[Sequence[float]], clip: str | None,
    margin: float, rank: bool = False, tie_key: Sequence[str] = (),
) -> DataFrame:
    """One row per weight vector with the Spearman correlation of its blend.

    ``rank`` first replaces each column by its ordinal percentile, equal values in the order of ``tie_key``.

    The weights are columns: a row carries all its blends and is never copied. Tasks fold equal values of a blend and pack
    the rest by cell, a stretch of values that a sample says holds CELL_ROWS rows; one shuffle brings the packs of
    each cell together. A cell gives the sums over its ranks as if it stood alone; those of the whole follow
    from the rows in the cells before. Cells only balance the work: the correlation is exact.
    """
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(tie_key)] if rank else []
    known = df.select(F.col(y).alias("_y"), *cols, *keys).dropna(subset=["_y", *cols])
    if rank:
        ordinal = [Rank(c, f"_rank_{c}", "ordinal") for c in cols]
        ranked = pct_ranks(known, ordinal, tie_key=[f"_key{i}" for i in range(len(keys))])
        known = ranked.select("_y", *[F.col(r.out).alias(r.col) for r in ordinal])
    # Narrow and read several times below.
    ranked = stage(add_rank(known, "_y", "_ry").select(*cols, "_ry"), "grid")
    n, spread = ranked.agg(F.count("*"), F.var_pop("_ry") * F.count("*")).first()
    vectors = [[float(w) for w in ws] for ws in weights]
    blends = F.array(*[clipped(_mix(cols, [F.lit(w) for w in ws]), clip, margin) for ws in vectors])
    middle = (n + 1) / 2
    rows = ranked.select((F.col("_ry") - F.lit(middle)).alias("s"), blends.alias("p"))
    packed = rows.mapInPandas(_packs(_cell_cuts(rows, n, len(vectors))), "grid_id int, cell int, p array<double>, c array<bigint>, s array<double>")
    cells = packed.groupBy("grid_id", "cell").applyInPandas(_cell_sums, "grid_id int, cell int, n bigint, l double, ll double, s double, sl double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grid_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A rank less the mean rank is the local rank plus this.
    shift = before.cast("double") - F.lit(middle)
    sums = cells.withColumn("b", shift).groupBy("grid_id").agg(
        F.sum(F.col("b") * F.col("b") * F.col("n") + 2 * F.col("b") * F.col("l") + F.col("ll")).alias("rr"),
        F.sum(F.col("b") * F.col("s") + F.col("sl")).alias("rs"),
    )
    found = sums.select("grid_id", F.try_divide(F.col("rs"), F.sqrt(F.col("rr") * F.lit(spread))).alias("spearman"))
    listed = df.sparkSession.createDataFrame(
        [(i, *ws) for i, ws in enumerate(vectors)], ", ".join(["grid_id int", *[f"`w_{c}` double" for c in cols]])
    )
    return listed.join(found, "grid_id", "left").select("grid_id", *[f"w_{c}" for c in cols], "spearman")


def _cell_cuts(rows: DataFrame, n: int, blends: int) -> list[np.ndarray]:
    """Per blend the values that part its cells, from a sample of about SAMPLE_ROWS rows."""
    cells = min(n // CELL_ROWS + 1, MOST_CELLS)
    if cells == 1:
        return [np.zeros(0)] * blends
    sample = np.stack(rows.sample(min(1.0, SAMPLE_ROWS / n), 0).select("p").toPandas()["p"].to_numpy())
    shares = np.arange(1, cells) / cells
    return [np.unique(np.quantile(sample[:, i], shares)) for i in range(blends)]


def _packs(cuts: list[np.ndarray]):
    """From rows of (s, p) to packs of (grid_id, cell, p, c, s): different values in order, their number and sum of s."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s, values = batch["s"].to_numpy(), np.stack(batch["p"].to_numpy())
            out = []
            for i, cut in enumerate(cuts):
                p, at, c = np.unique(values[:, i] + 0.0, return_inverse=True, return_counts=True)
                total = np.bincount(at, s, len(p))
                ends = np.searchsorted(p, cut, side="right")
                for cell, (a, b) in enumerate(zip([0, *ends], [*ends, len(p)])):
                    if a < b:
                        out.append((i, cell, p[a:b], c[a:b], total[a:b]))
            yield pd.DataFrame(out, columns=["grid_id", "cell", "p", "c", "s"])

    return pack


def _cell_sums(key: tuple, packs: pd.DataFrame) -> pd.DataFrame:
    """Rows of a cell and, of their average ranks within it, the sum, the sum of squares and the sum of products with s."""
    p, at = np.unique(np.concatenate(packs["p"].to_list()), return_inverse=True)
    c = np.bincount(at, np.concatenate(packs["c"].to_list()).astype(float), len(p))
    s = np.bincount(at, np.concatenate(packs["s"].to_list()), len(p))
    rank = np.cumsum(c) - (c - 1) / 2
    sums = {"n": int(c.sum()), "l": c @ rank, "ll": c @ rank ** 2, "s": s.sum(), "sl": s @ rank}
    return pd.DataFrame([{"grid_id": key[0], "cell": key[1], **sums}])


def grid_search_blend(
    df: DataFrame, a: str, b: str, y: str, step: float = 0.05, clip: str | None = None, margin: float = 0.1,
    rank: bool = False, tie_key: Sequence[str] = (),
) -> DataFrame:
    """Spearman correlation of ``(1 - w) * a + w * b`` for w = 0, step, ... 1, of percentiles if ``rank``."""
    points = round(1 / step)
    weights = [(1.0 - i / points, i / points) for i in range(points + 1)]
    return _search(df, [a, b], y, weights, clip, margin, rank, tie_key)


def simplex_weights(m: int, seed: int | str = 42) -> list[list[float]]:
    """Weight vectors for ``m`` models: uniform, each model alone, each pair, then random points.

    Random points are uniform on the simplex: keyed exponentials scaled to sum to 1.
    """
    wanted = max(5, min(11, int(100 / m))) * m * 2
    vectors = [[1.0 / m] * m]
    vectors += [[1.0 if j == i else 0.0 for j in range(m)] for i in range(m)]
    vectors += [[0.5 if k in pair else 0.0 for k in range(m)] for pair in combinations(range(m), 2)]
    for i in range(wanted - len(vectors)):
        draws = [int(md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:8], 16) for j in range(m)]
        lengths = [-log((d + 1) / 4294967297.0) for d in draws]
        vectors.append([x / sum(lengths) for x in lengths])
    return vectors


def simplex_search(
    df: DataFrame, cols: Sequence[str], y: str, seed: int | str = 42, clip: str | None = None, margin: float = 0.1,
    rank: bool = False, tie_key: Sequence[str] = (),
) -> DataFrame:
    """Spearman correlation of the blend for each vector of ``simplex_weights``, of percentiles if ``rank``."""
    return _search(df, cols, y, simplex_weights(len(cols), seed), clip, margin, rank, tie_key)


def best_blend(grid: DataFrame) -> DataFrame:
    """The row of the highest correlation, the earliest of several."""
    return grid.orderBy(F.desc_nulls_last("spearman"), F.asc("grid_id")).limit(1)


def fix_inversion(df: DataFrame, y: str, p: str, out: str) -> DataFrame:
    """``1 - p`` where the Spearman correlation with ``y`` is negative, else ``p``."""
    rho = spearman(df, y, p).first()["spearman"]
    return df.withColumn(out, F.lit(1.0) - F.col(p) if rho is not None and rho < 0 else F.col(p))


def final_blend(
    df: DataFrame, a: str, b: str, tie_key: Sequence[str], weights: Sequence[float] = (0.4, 0.6),
    clip: str | None = "soft", margin: float = 0.1, out: str = "final",
) -> DataFrame:
    """Replace both columns by their ordinal percentiles and add their clipped weighted sum."""
    ranked = pct_ranks(df, [Rank(a, "_ra", "ordinal"), Rank(b, "_rb", "ordinal")], tie_key=tie_key)
    mixed = F.lit(float(weights[0])) * F.col("_ra") + F.lit(float(weights[1])) * F.col("_rb")
    rest = [c for c in df.columns if c not in (a, b)]
    return ranked.select(*rest, F.col("_ra").alias(a), F.col("_rb").alias(b), clipped(mixed, clip, margin).alias(out))


def blend_report(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """One row per prediction column: mean squared error and Spearman correlation with ``y``."""
    # Narrow and read several times below.
    narrow = stage(df.select(F.col(y).alias("_y"), *cols), "report")
    long = narrow.select(
        "_y",
        F.inline(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("_p")) for c in cols])),
    ).dropna()
    errors = long.groupBy("model").agg(F.avg(F.pow(F.col("_y") - F.col("_p"), 2)).alias("mse"))
    corr = average_rank_corr(long, "_y", "_p", by=["model"], known_groups=len(cols))
    return errors.join(F.broadcast(corr), "model").select("model", "mse", "spearman")


def rank_report(
    df: DataFrame, p: str, text: str, clip: str | None = "soft", margin: float = 0.1, k: float | None = None
) -> DataFrame:
    """Texts with raw score, clipped score and percentile (0 to 100), best first.

    With ``k`` also the sigmoid-spread score.
    """
    from .scale import sigmoid_spread

    scored = df.select(F.col(text).alias("text"), F.col(p).alias("raw_score"))
    scored = scored.withColumn("score", clipped(F.col("raw_score"), clip or "unit", margin))
    scored = pct_rank(scored, "score", "percentile").withColumn("percentile", F.col("percentile") * 100)
    if k is not None:
        scored = sigmoid_spread(scored, "score", "spread_score", k)
    return scored.orderBy(F.desc("score"), F.asc("text"))


def progress_table(metrics: DataFrame, base: float = 0.7161, goal: float = 0.80) -> DataFrame:
    """Per row of (model, spearman): gain over ``base`` and the part of the way to ``goal`` in percent."""
    gain = F.col("spearman") - F.lit(base)
    return metrics.select(
        "model",
        "spearman",
        gain.alias("improvement"),
        (gain / F.lit(base) * 100).alias("improvement_pct"),
        (gain / F.lit(round(goal - base, 10)) * 100).alias("progress_pct"),
        (F.col("spearman") >= goal).alias("reached"),
    )
