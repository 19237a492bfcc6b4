"""The whole building step: feeds and service responses in, scored snapshots in the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.normalize import canonicalize, conform, union_sources
from ..schema import KEEP_REGIONS, SNAPSHOT_KEYS, FeatureConfig
from ..session import stage
from ..sources.ragged_csv import read_ragged_csv, with_provenance
from ..sources.warehouse import append_aligned
from .score import clean, score

# Of repeated snapshots the one with the highest counts stays; the rest settles ties.
KEEP_ORDER = ("viewCount", "likeCount", "commentCount", "rank", "publishedAt", "title", "source", "data_source")


def gather(spark: SparkSession, feeds: Mapping[str, str], responses: Sequence[DataFrame] = ()) -> DataFrame:
    """The rows of all feeds (tag to folder of CSV files) and of parsed responses, in the snapshot schema."""
    read = [with_provenance(read_ragged_csv(spark, root), tag, root) for tag, root in feeds.items()]
    frames = [conform(canonicalize(df)) for df in read] + [conform(df) for df in responses]
    if not frames:
        raise ValueError("neither feeds nor responses given")
    return union_sources(*frames)


def build_warehouse(
    spark: SparkSession,
    feeds: Mapping[str, str],
    path: str,
    now: str | Column,
    responses: Sequence[DataFrame] = (),
    order_col: Sequence[str] = KEEP_ORDER,
    keep_regions: Sequence[str] = KEEP_REGIONS,
    cfg: FeatureConfig | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read, unite, clean and score everything, append it to the table at ``path`` and report on it.

    The cleaned rows are written once: the report and the scores read them from there, so no CSV file is
    read again. Returns one row per source, null last: (source, n_rows, with_publishedAt, with_trendingDate) of what was appended.
    """
    cleaned = stage(clean(gather(spark, feeds, responses), list(order_col), keep_regions), "cleaned")
    append_aligned(score(cleaned, now, SNAPSHOT_KEYS, cfg), path, partition_by=partition_by)
    dates = {f"with_{c}": F.count(c) for c in ("publishedAt", "trendingDate")}
    report = cleaned.groupBy("source").agg(F.count("*").alias("n_rows"), *[v.alias(c) for c, v in dates.items()])
    return report.orderBy(F.col("source").asc_nulls_last())
