"""Keep-last tables fed by streams: arrivals by batch, merged into partitions from time to time.

A table is a folder of its own: ``arrived/batch=N`` holds what micro-batch N brought, ``settled`` the merged rows by
partition, ``merged`` the number of the last batch they contain. Merging the same rows twice changes nothing, so a batch or
a merge that is repeated after a failure leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.dedup import dedup_keep_last
from ..session import stage
from ..sources.warehouse import read_table

BATCH = "batch"
SLOT = "slot"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is kept in RocksDB, so it may outgrow the executors' memory."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run_batches(stream: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_keep_last(
    rows: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Bring what has arrived to the table: of each micro-batch the last row per key, filtered by ``keep``.

    The batch number names the folder, so a batch that is tried again replaces its first try. No state is kept between
    batches; rows may be as late as they like. Stops at the end of the present input.
    """
    def write(batch: DataFrame, number: int) -> None:
        wanted = keep(batch) if keep else batch
        dedup_keep_last(wanted, keys, order).write.mode("overwrite").parquet(f"{table}/arrived/{BATCH}={number}")

    _run_batches(rows, "append", checkpoint, write)


def ingest_changes(changes: DataFrame, table: str, checkpoint: str) -> None:
    """Bring the changed groups of a streaming aggregation to the table, one folder per micro-batch.

    Open groups are part of it from their first row on. Read with ``latest(..., order=[BATCH])``.
    """
    with state_on_disk(changes.sparkSession):
        _run_batches(changes, "update", checkpoint, lambda batch, number: batch.write.mode("overwrite").parquet(f"{table}/arrived/{BATCH}={number}"))


def _merged_up_to(spark: SparkSession, table: str) -> int:
    marks = read_table(spark, f"{table}/merged")
    return -1 if marks is None else marks.agg(F.max("upto")).first()[0]


def _waiting(spark: SparkSession, table: str) -> DataFrame | None:
    """Arrivals that are not merged yet; only their folders are read."""
    arrived = read_table(spark, f"{table}/arrived")
    return None if arrived is None else arrived.where(F.col(BATCH) > _merged_up_to(spark, table))


def latest(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table as it is now: settled rows and waiting arrivals, the last per key in ``order``; ``batch`` says where from."""
    settled, waiting = read_table(spark, f"{table}/settled"), _waiting(spark, table)
    parts = [p for p in (settled.drop(SLOT) if settled is not None else None, waiting) if p is not None]
    if not parts:
        raise FileNotFoundError(table)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return dedup_keep_last(rows, keys, order)


def compact(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[str], slot: Column) -> int:
    """Merge waiting arrivals into the settled rows; returns the number of the last batch merged.

    ``slot`` parts the table, say into months, and may depend on the key alone. Only slots with arrivals are read and
    written again: the slots of the arrivals prune the settled folders, and dynamic overwrite leaves the others alone.
    The mark is written last; a merge that was cut off is simply made again.
    """
    waiting = _waiting(spark, table)
    upto = None if waiting is None else waiting.agg(F.max(BATCH)).first()[0]
    if upto is None:
        return _merged_up_to(spark, table)
    fresh = dedup_keep_last(waiting.where(F.col(BATCH) <= upto).withColumn(SLOT, slot.cast("string")), [SLOT, *keys], order)
    settled = read_table(spark, f"{table}/settled")
    if settled is not None:
        fresh = stage(fresh, "fresh")
        touched = stage(fresh.select(F.col(SLOT).alias("touched")).distinct(), "slots")
        old = settled.join(touched, F.col(SLOT).cast("string").eqNullSafe(F.col("touched")), "left_semi").withColumn(SLOT, F.col(SLOT).cast("string"))
        fresh = stage(dedup_keep_last(old.unionByName(fresh), [SLOT, *keys], order), "merged")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(f"{table}/settled")
    spark.createDataFrame([(upto,)], "upto bigint").write.mode("append").parquet(f"{table}/merged")
    return upto
