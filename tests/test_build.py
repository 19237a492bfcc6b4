"""The composed building step on small raw files."""

import pytest
from pyspark.sql import functions as F

from trendspark.plans.build import build_warehouse
from trendspark.sources.ragged_csv import read_ragged_csv
from trendspark.sources.trending_json import parse_trending_json
from trendspark.sources.warehouse import read_table
from workload import queries

NOW = "2024-02-01 00:00:00"


def feed(folder, name, lines):
    (folder / name).mkdir(parents=True)
    (folder / name / "part.csv").write_text("\n".join(lines) + "\n")
    return str(folder / name)


def test_feeds_and_responses_become_one_table(spark, tmp_path):
    daily = feed(tmp_path, "daily", [
        "video_id,title,publish_time,snapshot_date,country,view_count,likes,daily_rank",
        "a,first,2024-01-01 00:00:00,2024-01-02,US,100,5,1", "a,first,2024-01-01 00:00:00,2024-01-02,US,200,6,1", "b,far,2024-01-01 00:00:00,2024-01-02,XX,9,1,2",
    ])
    many = feed(tmp_path, "many", ["id,title,publishedAt,trending_date,region,views,comment_count", "c,third,2024-01-01 00:00:00,2024-01-03,GB,oops,4"])
    body = '{"items":[{"id":"a","snippet":{"title":"first","publishedAt":"2024-01-01T00:00:00Z"},"statistics":{"viewCount":"150"}},{"id":"d","snippet":{"title":"new"},"statistics":{}}]}'
    answers = parse_trending_json(spark.createDataFrame([(body,)], "body string"), "body", F.lit("US"), F.lit("2024-01-02"))
    path = str(tmp_path / "table")
    report = build_warehouse(spark, {"daily": daily, "many": many}, path, NOW, [answers], keep_regions=("US", "GB"))
    assert [tuple(r) for r in report.collect()] == [("api", 1, 0, 1), ("daily", 1, 1, 1), ("many", 1, 1, 1)]
    rows = {r.videoId: r for r in read_table(spark, path).collect()}
    assert {k: (r.viewCount, r.source) for k, r in rows.items()} == {"a": (200, "daily"), "c": (0, "many"), "d": (0, "api")}
    assert all(0 <= r.viral_score <= 1 for r in rows.values())
    # A later run is appended to what is there.
    build_warehouse(spark, {"many": many}, path, NOW, keep_regions=("GB",))
    assert read_table(spark, path).count() == 4


def test_nothing_given(spark, tmp_path):
    with pytest.raises(ValueError):
        build_warehouse(spark, {}, str(tmp_path / "table"), NOW)


def test_landed_feeds_are_packed_and_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(queries, "FEED_ROWS", 40)
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('say "a, b" '), "id").alias("title")).repartition(3)
    path = queries._packed_folder(df, "feed")
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    assert len(found) >= 8 and all(r.path.endswith(".csv.gz") for r in found)
    back = read_ragged_csv(spark, path)
    assert sorted(map(tuple, back.select("id", "title").collect())) == sorted(map(tuple, df.collect()))
    assert back.groupBy("_file").count().where("count > 40").isEmpty()
