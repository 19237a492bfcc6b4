"""The snapshot table on storage, and the files written from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.filters import filter_quality
from ..operators.normalize import coerce_timestamps
from ..operators.sampling import sample_n

# The columns read for training.
TRAINING_COLUMNS = (
    "videoId", "title", "description", "publishedAt", "trendingDate",
    "viewCount", "likeCount", "commentCount", "rank", "region",
)

# The columns of the exported sample, of which those present are written.
EXPORT_COLUMNS = (
    "videoId", "title", "publishedAt", "viewCount", "likeCount", "commentCount", "viral_score",
    "viral_factor", "view_performance", "engagement_ratio",
)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none yet. Columns added later are null in old rows."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def align(df: DataFrame, target: T.StructType) -> DataFrame:
    """The columns of ``target`` that ``df`` has, cast to the types of the target."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in target.fields if f.name in df.columns])


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` with the columns of ``target`` it lacks added as null."""
    missing = [f for f in target.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def append_aligned(
    df: DataFrame, path: str, create: bool = True, add_columns: Sequence[str] = ("data_source",),
    partition_by: Sequence[str] = (),
) -> None:
    """Append by column name to the Parquet table at ``path``, making it if absent.

    Columns unknown to the table are left out, apart from those in ``add_columns``, which widen it.
    Rows already in the table are not looked at.
    """
    table = read_table(df.sparkSession, path)
    if table is None:
        if not create:
            raise FileNotFoundError(path)
        rows = df
    else:
        widened = [df.schema[c] for c in add_columns if c in df.columns and c not in table.columns]
        target = T.StructType(list(table.schema.fields) + widened)
        rows = evolve_schema(align(df, target), target).select(*target.fieldNames())
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views the session knows."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, is_temporary boolean")


def load_training_rows(
    df: DataFrame, min_views: int = 100, max_rows: int | None = None, key: Sequence[str] = ("videoId",),
    seed: int | str = 42,
) -> DataFrame:
    """Rows of sufficient quality with the training columns, at random at most ``max_rows`` of them."""
    good = filter_quality(df, min_views)
    if max_rows is not None:
        good = sample_n(good, max_rows, key, seed)
    wanted = [c for c in TRAINING_COLUMNS if c in good.columns]
    return coerce_timestamps(good.select(*wanted, *[k for k in key if k not in wanted]))


def load_summary(df: DataFrame) -> DataFrame:
    """One row: rows, date range and view range."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min("publishedAt").alias("first_date"), F.max("publishedAt").alias("last_date"),
        F.min("viewCount").alias("min_views"), F.max("viewCount").alias("max_views"),
    )


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Write the splits as partitions of one Parquet data set."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def export_sample(
    df: DataFrame, path: str, n: int = 1000, key: Sequence[str] = ("videoId",), seed: int | str = 42,
    cols: Sequence[str] = EXPORT_COLUMNS,
) -> DataFrame:
    """Write a random sample as CSV, with those of ``cols`` that exist. Returns what was written."""
    sample = sample_n(df, n, key, seed).select(*[c for c in cols if c in df.columns])
    sample.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return sample


def write_predictions(df: DataFrame, metrics: DataFrame, weights: DataFrame, path: str) -> None:
    """Write predictions, metrics and blend weights side by side below ``path``."""
    df.write.mode("overwrite").parquet(f"{path}/predictions")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    weights.write.mode("overwrite").parquet(f"{path}/weights")
