"""Keep-last tables fed by streams, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trendspark.streaming import ingest, settle

RAW = "k string, day string, v bigint"
KEYS, ORDER = ["k", "day"], ["v"]


def lander(spark, tmp_path):
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))

    def land(rows, files=2):
        spark.createDataFrame(rows, RAW).repartition(files).write.mode("append").json(landing)
        stream = ingest.file_stream(spark, landing, spark.createDataFrame([], RAW).schema, "json", files_per_trigger=1)
        settle.ingest_keep_last(stream, table, progress, KEYS, ORDER, keep=lambda df: df.where("v >= 0"))

    return table, land


def now(spark, table):
    return sorted((r.k or "", r.day or "", r.v) for r in settle.latest(spark, table, KEYS, ORDER).collect())


def want(rows):
    best = {}
    for k, day, v in rows:
        if v >= 0:
            best[k, day] = max(v, best.get((k, day), v))
    return sorted((k or "", day or "", v) for (k, day), v in best.items())


def test_latest_is_the_last_row_whatever_came_when(spark, tmp_path):
    table, land = lander(spark, tmp_path)
    draw = random.Random(5)
    seen = []
    for step in range(3):
        rows = [(draw.choice("abcdef"), draw.choice(["d1", "d2", None]), draw.randint(-2, 50)) for _ in range(40)]
        rows += draw.sample(seen, min(10, len(seen)))  # late and repeated rows
        seen += rows
        land(rows)
        assert now(spark, table) == want(seen)
        if step != 1:
            settle.compact(spark, table, KEYS, ORDER, F.col("day"))
            assert now(spark, table) == want(seen)
    assert settle._waiting(spark, table).count() == 0
    assert spark.read.parquet(f"{table}/settled").count() == len(want(seen))


def test_only_slots_with_arrivals_are_written_again(spark, tmp_path):
    table, land = lander(spark, tmp_path)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{table}/settled") for f in fs if f.endswith(".parquet")}
    land([("a", "d1", 1), ("a", "d2", 1), ("b", None, 3)])
    first = settle.compact(spark, table, KEYS, ORDER, F.col("day"))
    before = files()
    assert settle.compact(spark, table, KEYS, ORDER, F.col("day")) == first and files() == before  # nothing waits
    land([("a", "d2", 0), ("c", "d2", 4)])
    assert settle.compact(spark, table, KEYS, ORDER, F.col("day")) > first
    kept = {f for f in before if "slot=d2" not in f}
    assert len(kept) == 2 and kept <= files() and not (before - kept) & files()
    assert now(spark, table) == [("a", "d1", 1), ("a", "d2", 1), ("b", "", 3), ("c", "d2", 4)]


def test_a_batch_or_merge_that_is_repeated_changes_nothing(spark, tmp_path):
    table, land = lander(spark, tmp_path)
    land([("a", "d1", 1), ("a", "d1", 2), ("b", "d1", 7)], files=1)
    first = sorted(map(tuple, spark.read.parquet(f"{table}/arrived").collect()))
    # The sink's part of a batch again, as after a lost acknowledgement.
    spark.createDataFrame([("a", "d1", 2), ("b", "d1", 7)], RAW).write.mode("overwrite").parquet(f"{table}/arrived/batch=0")
    assert sorted(map(tuple, spark.read.parquet(f"{table}/arrived").collect())) == first
    before = now(spark, table)
    mark = spark.createDataFrame([(-1,)], "upto bigint")
    settle.compact(spark, table, KEYS, ORDER, F.col("day"))
    mark.write.mode("overwrite").parquet(f"{table}/merged")  # the merge was made but its mark is lost
    settle.compact(spark, table, KEYS, ORDER, F.col("day"))
    assert now(spark, table) == before and spark.read.parquet(f"{table}/settled").count() == 2


def test_without_rows(spark, tmp_path):
    table, land = lander(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        settle.latest(spark, table, KEYS, ORDER)
    assert settle.compact(spark, table, KEYS, ORDER, F.col("day")) == -1
    land([("a", "d1", -1)], files=1)
    assert now(spark, table) == []
    settle.compact(spark, table, KEYS, ORDER, F.col("day"))
    assert now(spark, table) == []


def test_coverage_has_open_windows_and_no_rows_past_the_watermark(spark, tmp_path):
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))
    names = "ts string, source string, v double"

    def step(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").json(landing)
        stream = ingest.file_stream(spark, landing, spark.createDataFrame([], names).schema, "json").withColumn("ts", F.to_timestamp("ts"))
        settle.ingest_changes(ingest.coverage_stream(stream, "ts", "source", "v", (0.5,), "1 day"), table, progress)
        got = settle.latest(spark, table, ["window_start", "source"], [settle.BATCH]).collect()
        return sorted((str(r.window_start)[8:10], r.source, r.total, r.with_value, r.ge_0_5) for r in got)

    assert step([("2023-01-01 10:00:00", "x", 0.7), ("2023-01-02 11:00:00", "x", None)]) == [("01", "x", 1, 1, 1), ("02", "x", 1, 0, 0)]
    # Late, but the watermark stands at 11:00 of the first day.
    assert step([("2023-01-01 09:00:00", "x", 0.1), ("2023-01-05 00:00:00", "y", 0.9)])[0] == ("01", "x", 2, 2, 1)
    # The watermark has passed the first two days.
    assert step([("2023-01-01 12:00:00", "x", 0.9), ("2023-01-05 01:00:00", "y", None)]) == [
        ("01", "x", 2, 2, 1), ("02", "x", 1, 0, 0), ("05", "y", 2, 1, 1)
    ]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
