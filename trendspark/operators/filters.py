"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import KEEP_REGIONS


def filter_regions(df: DataFrame, keep: Sequence[str] = KEEP_REGIONS, col: str = "region") -> DataFrame:
    """Rows of the listed regions and rows without a region."""
    return df.where(F.col(col).isNull() | F.col(col).isin(*keep))


def filter_quality(df: DataFrame, min_views: int = 100) -> DataFrame:
    """Rows with title, description and publication date, and at least ``min_views`` views."""
    has_all = F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("publishedAt").isNotNull()
    return df.where(has_all & (F.col("viewCount") >= min_views))


def filter_score(df: DataFrame, low: float, col: str = "viral_score") -> DataFrame:
    """Rows with title and description that score at least ``low``."""
    return df.where((F.col(col) >= low) & F.col("title").isNotNull() & F.col("description").isNotNull())


def recent(col: str, years: int, as_of: str, keep_null: bool = True) -> Column:
    """True for dates of the last ``years`` years before ``as_of`` and, if asked, for no date."""
    start = F.add_months(F.to_date(F.lit(as_of)), -12 * years).cast("timestamp")
    inside = F.col(col).cast("timestamp") >= start
    return (F.col(col).isNull() | inside) if keep_null else F.coalesce(inside, F.lit(False))


def filter_recent(
    df: DataFrame, years: int, as_of: str, col: str = "publishedAt", keep_null: bool = True
) -> DataFrame:
    """Rows that are ``recent``."""
    return df.where(recent(col, years, as_of, keep_null))
