"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trendspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC clock and adaptive plans."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    On ``local[...]`` without that setting a temporary folder is made. On a cluster without it
    the answer is None: a machine-local folder would not be seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trendspark-"))
        return context.getCheckpointDir()
    return None


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    root = shared_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, or to ``folder``, and read it back.

    Used where a frame is scanned several times: later passes become column-pruned Parquet scans,
    and the written files survive the loss of executors. On a cluster without a shared folder this
    raises, as ``new_folder`` does.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of staged frames that nothing reads any more, and let the shuffle files of what was run go."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Let the shuffle files of what was run go: Spark removes them once the driver has collected the frames they belong to."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions, the measure for how finely to cut work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
