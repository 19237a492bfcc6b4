"""Landed responses of a trending-videos service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RESPONSE = (
    "items array<struct<id: string,"
    " snippet: struct<title: string, description: string, publishedAt: string>,"
    " statistics: struct<viewCount: string, likeCount: string, commentCount: string>>>"
)


def parse_trending_json(df: DataFrame, body: str, region: Column, run_date: Column, source: str = "api") -> DataFrame:
    """One snapshot row per item of each response in column ``body``.

    Absent counts are 0, there is no rank, and the trending date is the date of the run.
    """
    items = df.select(
        region.alias("region"),
        F.to_date(run_date).alias("_day"),
        F.explode(F.from_json(F.col(body), RESPONSE)["items"]).alias("it"),
    )

    def count(name: str) -> Column:
        return F.coalesce(F.col(f"it.statistics.{name}").try_cast("bigint"), F.lit(0).cast("bigint")).alias(name)

    day = F.date_format("_day", "yyyy-MM-dd")
    return items.select(
        F.col("it.id").alias("videoId"),
        F.col("it.snippet.title").alias("title"),
        F.col("it.snippet.description").alias("description"),
        F.try_to_timestamp(F.col("it.snippet.publishedAt")).alias("publishedAt"),
        F.col("_day").cast("timestamp").alias("trendingDate"),
        "region",
        count("viewCount"),
        count("likeCount"),
        count("commentCount"),
        F.lit(None).cast("bigint").alias("rank"),
        F.lit(source).alias("source"),
        F.concat_ws("_", F.lit(source), "region", day).alias("data_source"),
    )
