"""Evaluation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rank import Rank, add_ranks, position


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known, null if one of them is constant."""
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def mse(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error, overall or per group."""
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"))


def average_rank_corr(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), known_groups: int | None = None
) -> DataFrame:
    """Pearson correlation of the average-tie ranks, with the number of rows it rests on."""
    known = df.select(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).where("_y is not null and _p is not null")
    ranked = add_ranks(known, [Rank("_y", "_ry"), Rank("_p", "_rp")], by, known_groups=known_groups)
    grouped = ranked.groupBy(*by) if by else ranked
    return grouped.agg(F.count("*").alias("n"), safe_corr(F.col("_ry"), F.col("_rp")).alias("spearman"))


def spearman(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), known_groups: int | None = None
) -> DataFrame:
    """Spearman correlation, overall or per group, over rows where both columns are known."""
    return average_rank_corr(df, y, p, by, known_groups)


def metrics_by(
    df: DataFrame, y: str, p: str, by: str, min_n: int = 10, known_groups: int | None = None
) -> DataFrame:
    """Per group of at least ``min_n`` rows: rows, mean squared error and Spearman correlation.

    Rows of too small groups leave before anything is ranked.
    """
    known = df.select(F.col(by), F.col(y).alias("_y"), F.col(p).alias("_p")).where("_y is not null and _p is not null")
    errors = (
        known.groupBy(by)
        .agg(F.count("*").alias("n"), F.avg(F.pow(F.col("_y") - F.col("_p"), 2)).alias("mse"))
        .where(F.col("n") >= min_n)
    )
    large = known.join(errors.select(F.col(by).alias("_g")), F.col(by).eqNullSafe(F.col("_g")), "left_semi")
    corr = average_rank_corr(large, "_y", "_p", [by], known_groups).drop("n")
    joined = errors.join(corr.withColumnRenamed(by, "_g"), F.col(by).eqNullSafe(F.col("_g")))
    return joined.select(by, "n", "mse", "spearman")


def cardinality_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: distinct values, and "binary" (up to 2), "few" (below 10) or "ok"."""
    wide = df.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        d = F.col(f"d{i}")
        verdict = F.when(d <= 2, "binary").when(d < 10, "few").otherwise("ok")
        rows.append(F.struct(F.lit(c).alias("model"), d.alias("n_unique"), verdict.alias("verdict")))
    return wide.select(F.inline(F.array(*rows)))


def with_batches(
    df: DataFrame, order_col: str, tie_key: Sequence[str], batch_size: int = 32, out: str = "batch"
) -> DataFrame:
    """Cut the rows, in the order of ``order_col``, into batches of ``batch_size``."""
    placed = position(df, order_col, "_pos", tie_key)
    return placed.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size))).drop("_pos")


def pairwise_rank_loss(
    df: DataFrame, y: str, p: str, order_col: str, tie_key: Sequence[str], batch_size: int = 32,
    kind: str = "hinge", base_margin: float = 0.1, adaptive: bool = True, boundary: bool = True,
    temperature: float = 1.0,
) -> DataFrame:
    """Ranking loss of each batch of ``batch_size`` rows.

    For every two rows with y_i > y_j the margin is max(2 (y_i - y_j), base_margin). The loss of the
    pair is the hinge max(0, margin - (p_i - p_j)), or for ``kind`` "soft" the sigmoid of p_j - p_i,
    times the weight min(1 + exp(-10 (p_i - p_j - margin / 2) / margin), 5). The loss of the batch is
    the mean over its pairs, or the mean squared error if it has none.

    A batch holds at most ``batch_size`` rows by construction. Its rows are gathered in one array
    and compared there; no pair ever becomes a row.
    """
    if kind not in ("hinge", "soft"):
        raise ValueError(f"unknown kind {kind!r}")
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    batched = with_batches(known, order_col, tie_key, batch_size)
    arrays = batched.groupBy("batch").agg(
        F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))).alias("xs"),
        F.count("*").alias("n"),
        F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("_mse"),
    )

    def pair_loss(a, b):
        gap = a["p"] - b["p"]
        if adaptive:
            margin = F.greatest((a["y"] - b["y"]) * F.lit(2.0), F.lit(base_margin))
        else:
            margin = F.lit(base_margin)
        if kind == "hinge":
            loss = F.greatest(margin - gap, F.lit(0.0))
        else:
            loss = F.lit(1.0) / (F.lit(1.0) + F.exp(gap / F.lit(temperature)))
        if not boundary:
            return loss
        weight = F.lit(1.0) + F.exp(F.lit(-10.0) * (gap - F.lit(0.5) * margin) / margin)
        return loss * F.least(weight, F.lit(5.0))

    def row_losses(a):
        lower = F.filter("xs", lambda b: b["y"] < a["y"])
        summed = F.aggregate(lower, F.lit(0.0), lambda acc, b: acc + pair_loss(a, b))
        return F.struct(summed.alias("s"), F.size(lower).cast("bigint").alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("c"))
    folded = F.aggregate(
        F.transform("xs", row_losses),
        zero,
        lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), (acc["c"] + x["c"]).alias("c")),
    )
    summed = arrays.withColumn("_t", folded)
    return summed.select(
        "batch",
        "n",
        F.col("_t.c").alias("n_pairs"),
        F.when(F.col("_t.c") > 0, F.col("_t.s") / F.col("_t.c")).otherwise(F.col("_mse")).alias("loss"),
    )


def preference_pairs(
    df: DataFrame, score: str, text: str, order_col: str, tie_key: Sequence[str], batch_size: int = 32
) -> DataFrame:
    """Neighbours in the order of ``score`` within each batch: the better is chosen, the other rejected.

    Equal scores are ordered by position; the last row of an odd batch has no partner.
    """
    placed = position(df, order_col, "_pos", tie_key)
    batched = placed.withColumn("batch", F.floor(F.col("_pos") / F.lit(batch_size)))
    inner = Window.partitionBy("batch").orderBy(F.desc_nulls_last(score), F.asc("_pos"))
    numbered = batched.withColumn("_rn", F.row_number().over(inner) - 1)
    paired = numbered.withColumn("pair", F.floor(F.col("_rn") / F.lit(2)))
    return (
        paired.groupBy("batch", "pair")
        .agg(
            F.max(F.when(F.col("_rn") % 2 == 0, F.col(text))).alias("chosen"),
            F.max(F.when(F.col("_rn") % 2 == 1, F.col(text))).alias("rejected"),
            F.count("*").alias("_n"),
        )
        .where("_n = 2")
        .drop("_n")
    )


def reversed_pairs(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """The response is chosen and its reversal rejected."""
    return df.select(
        F.col(prompt).alias("prompt"), F.col(response).alias("chosen"), F.reverse(F.col(response)).alias("rejected")
    )
