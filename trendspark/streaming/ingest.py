"""Incremental ingest of landed snapshot files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.normalize import canonicalize, conform
from ..schema import SNAPSHOT_SCHEMA


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files below ``path`` as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def snapshot_stream(raw: DataFrame, schema: T.StructType = SNAPSHOT_SCHEMA) -> DataFrame:
    """Raw rows as snapshots, by the same projection as in batch."""
    return conform(canonicalize(raw), schema)


def dedup_stream(df: DataFrame, keys: Sequence[str], time_col: str, delay: str) -> DataFrame:
    """First row per key; keys are remembered until the watermark has passed them by ``delay``.

    Batch cleaning keeps the last row per key: see ``settle`` for a table that does.
    """
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_stream(
    rows: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], time_col: str, delay: str = "1 day",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Filter, de-duplicate and append everything that has arrived to the Parquet table ``sink``.

    Runs to the end of the present input and stops; the next run goes on where this one ended.
    """
    wanted = keep(rows) if keep else rows
    query = (
        dedup_stream(wanted, keys, time_col, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def coverage_stream(
    rows: DataFrame, time_col: str, by: str, value: str, thresholds: Sequence[float], delay: str = "1 day",
    width: str = "1 day",
) -> DataFrame:
    """Per window and group: rows, rows with a value, and rows at or above each threshold."""
    counts = [F.count("*").alias("total"), F.count(value).alias("with_value")]
    counts += [F.count_if(F.col(value) >= t).alias(f"ge_{t:g}".replace(".", "_")) for t in thresholds]
    grouped = rows.withWatermark(time_col, delay).groupBy(F.window(time_col, width), by).agg(*counts)
    return grouped.select(F.col("window.start").alias("window_start"), by, *[c for c in grouped.columns[2:]])


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; with a watermark only closed windows are appended."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
