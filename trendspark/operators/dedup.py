"""Removal and counting of duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``; null keys are equal to each other.

    The filter on the row number makes Spark keep one row per key and task before the shuffle, so
    many copies of one key never meet in one task. The leading hash keeps comparisons of long
    keys short.
    """
    marked = df.withColumn("_kh", F.xxhash64(*keys))
    first = Window.partitionBy("_kh", *keys).orderBy(*order)
    return marked.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_kh")


def _names(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order_col: str | Sequence[str]) -> DataFrame:
    """Of the rows with equal keys keep the last in the order of one or more columns."""
    return _one_per_key(df, keys, [F.col(c).desc_nulls_last() for c in _names(order_col)])


def dedup_text(df: DataFrame, cols: Sequence[str], order_col: str | Sequence[str]) -> DataFrame:
    """Of the rows with exactly equal texts keep the first in the order of one or more columns.

    Rows are sorted with all their columns. Where many rows refer to few long texts, compare the digests of ``Referred``.
    """
    return _one_per_key(df, cols, [F.col(c).asc_nulls_last() for c in _names(order_col)])


@dataclass(frozen=True)
class Referred:
    """Texts kept apart from the rows that refer to them: ``text`` of the rows of ``df`` whose ``id`` equals a row's ``ref``.

    Rows can be compared by the digest of their text and get the text itself when few are left.
    """

    df: DataFrame
    ref: str
    id: str
    text: str
    digest: str = "_digest"

    def _sha(self) -> Column:
        return F.sha2(F.col(self.text).cast("binary"), 256).alias(self.digest)

    def with_digest(self, rows: DataFrame) -> DataFrame:
        """Add the SHA-256 of the text, worked out once per text; a left join, so null without a text."""
        found = self.df.select(F.col(self.id).alias("_id"), self._sha())
        return rows.join(found, F.col(self.ref) == F.col("_id"), "left").drop("_id")

    def with_text(self, rows: DataFrame, out: str) -> DataFrame:
        """Put the text in the place of the digest, under the name ``out``."""
        texts = self.df.select(self._sha(), F.col(self.text).alias(out)).groupBy(self.digest).agg(F.first(out).alias(out))
        return rows.join(texts, self.digest, "left").drop(self.digest)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    per_key = df.groupBy(F.xxhash64(*keys).alias("_kh"), *keys).agg(F.count("*").alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"),
    )
