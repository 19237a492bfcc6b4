"""Operators that scale columns by statistics of the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import sigmoid
from .quantiles import as_number, exact_quantiles


Stats = Mapping[str, tuple[float, float]]


def robust_stats(df: DataFrame, cols: Sequence[str]) -> Stats:
    """Per column its median and its spread: the interquartile range, or 1 where that is not positive."""
    fitted = {}
    for c, (low, middle, high) in exact_quantiles(df, cols, (0.25, 0.5, 0.75)).items():
        if middle is None:
            fitted[c] = (0.0, 1.0)
        else:
            fitted[c] = (middle, high - low if high > low else 1.0)
    return fitted


def robust_sigmoid(df: DataFrame, outputs: Mapping[str, str], stats: Stats | None = None) -> DataFrame:
    """Add ``outputs[c]`` = sigmoid((c - median) / spread) for each column ``c``.

    ``stats`` takes the result of an earlier ``robust_stats``, to score new rows on a frozen scale.
    """
    fitted = stats if stats is not None else robust_stats(df, list(outputs))
    return df.withColumns(
        {
            out: sigmoid((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]))
            for c, out in outputs.items()
        }
    )


def fit_standardizer(df: DataFrame, col: str) -> DataFrame:
    """One row: mean and population standard deviation of ``col``."""
    return df.agg(F.avg(as_number(col)).alias("mean"), F.stddev_pop(as_number(col)).alias("std"))


def standardize(df: DataFrame, col: str, stats: DataFrame, out: str) -> DataFrame:
    """``(col - mean) / std`` with the numbers of ``fit_standardizer``."""
    return (
        df.withColumn("_stats", stats.select(F.struct("mean", "std").alias("s")).scalar())
        .withColumn(out, (F.col(col) - F.col("_stats.mean")) / F.col("_stats.std"))
        .drop("_stats")
    )


def unstandardize(df: DataFrame, col: str, stats: DataFrame, out: str) -> DataFrame:
    """``col * std + mean``, the way back."""
    return (
        df.withColumn("_stats", stats.select(F.struct("mean", "std").alias("s")).scalar())
        .withColumn(out, F.col(col) * F.col("_stats.std") + F.col("_stats.mean"))
        .drop("_stats")
    )


def sigmoid_spread(df: DataFrame, col: str, out: str, k: float = 5.0) -> DataFrame:
    """Min-max scale ``col``, then sigmoid of steepness ``k`` around 0.5; a constant column scales to 0."""
    extent = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = F.col("_x.hi") - F.col("_x.lo")
    part = F.when(width > 0, (F.col(col) - F.col("_x.lo")) / width).otherwise(F.lit(0.0))
    return (
        df.withColumn("_x", extent.select(F.struct("lo", "hi").alias("s")).scalar())
        .withColumn(out, sigmoid(F.lit(float(k)) * (part - F.lit(0.5))))
        .drop("_x")
    )
