import gzip
import json

import pytest
from pyspark.sql import functions as F, types as T

from trendspark.operators.normalize import (
    canonicalize, coerce_counts, coerce_timestamps, conform, drop_repeated_columns, union_sources,
)
from trendspark.schema import SNAPSHOT_SCHEMA
from trendspark.sources import ragged_csv as rc
from trendspark.sources.trending_json import parse_trending_json
from trendspark.sources import warehouse as wh

DAILY = ("videoId,title,description,publishedAt,channelId,channelTitle,categoryId,trending_date,tags,view_count,likes,"
         "dislikes,comment_count,thumbnail_link,comments_disabled,ratings_disabled,video_error_or_removed,description")
MANY = ("video_id,title,description,publish_time,trending_date,country,view_count,likes,dislikes,comment_count,"
        "comments_disabled,ratings_disabled,video_error_or_removed,category_id,channel_id,channel_title,tags,thumbnail_link")


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ragged_rows(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,title,views\n1,plain,10\n2,short\n3,long,1,2\n4,"two\nlines, ""quoted""",40\n\n5,NA,50\n')
    df = rc.read_ragged_csv(spark, str(tmp_path))
    assert rows(df, "id", "title", "views") == [
        ("1", "plain", "10"), ("2", "short", None), ("4", 'two\nlines, "quoted"', "40"), ("5", None, "50")]


def test_encodings_headers_folders_and_gzip(spark, tmp_path):
    write(tmp_path, "latin.csv", "id,title\n1,café\n", "latin-1")
    write(tmp_path, "utf.csv", "﻿id,title\n2,café 漢\n")
    write(tmp_path, "deep/er/other.csv", "title,video_id\nx,3\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt", encoding="utf-8") as f:
        f.write("id,title\n4,zipped\n")
    df = rc.read_ragged_csv(spark, str(tmp_path))
    assert sorted(map(str, [tuple(r) for r in df.select("id", "title", "video_id").collect()])) == sorted(map(str, [
        ("1", "café", None), ("2", "café 漢", None), (None, "x", "3"), ("4", "zipped", None)]))


def test_unbalanced_quote_falls_back(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,title\n1,"open\n2,fine\n3,also\\,fine\n')
    df = rc.read_ragged_csv(spark, str(tmp_path))
    assert rows(df, "id", "title") == [("1", '"open'), ("2", "fine"), ("3", "also,fine")]
    layout = rc.inspect_files(spark, str(tmp_path)).first()
    assert not layout.quoted and not layout.whole_lines


def test_inner_quotes_are_plain(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,title\n1,5" wide and 6" high\n2,ok\n')
    assert rows(rc.read_ragged_csv(spark, str(tmp_path)), "id", "title") == [("1", '5" wide and 6" high'), ("2", "ok")]


def test_report_provenance_and_cap(spark, tmp_path):
    write(tmp_path, "gaming/a.csv", "id\n1\n2\n3\n")
    write(tmp_path, "b.csv", "id\n")
    write(tmp_path, "c.csv", "")
    df = rc.read_ragged_csv(spark, str(tmp_path))
    report = rc.file_load_report(spark, str(tmp_path), df)
    assert sorted((r.file.split("/")[-1], r.rows, r.status) for r in report.collect()) == [
        ("a.csv", 3, "loaded"), ("b.csv", 0, "empty"), ("c.csv", 0, "error")]
    total = rc.load_totals(report).first()
    assert (total.n_files, total.loaded, total.empty, total.error, total.rows) == (3, 1, 1, 1, 3)
    tagged = rc.with_path_category(rc.with_provenance(df, "daily", str(tmp_path)))
    assert {tuple(r) for r in tagged.select("source", "data_source", "category").collect()} == {
        ("daily", "daily_gaming/a.csv", "gaming")}
    capped = rc.read_ragged_csv(spark, str(tmp_path), max_rows_per_file=2)
    assert rows(capped, "id") == [("1",), ("2",)]
    with pytest.raises(FileNotFoundError):
        rc.read_ragged_csv(spark, str(write(tmp_path, "none/x.csv", "").parent))


def test_feeds_reach_the_snapshot_schema(spark, tmp_path):
    write(tmp_path, "daily/d.csv", DAILY + "\nv1,T,first,2023-01-01T00:00:00Z,c,ch,1,2023-01-02,x,1000,50,1,7,l,F,F,F,second\n")
    write(tmp_path, "many/m.csv", MANY + '\nv2,T2,D2,2023-01-03,2023-01-04,GB,"2,000",60,1,8.9,F,F,F,1,c,ch,x,l\n')
    frames = []
    for name in ("daily", "many"):
        raw = rc.with_provenance(rc.read_ragged_csv(spark, str(tmp_path / name)), name, str(tmp_path / name))
        frames.append(conform(canonicalize(raw)))
    df = union_sources(*frames)
    assert df.schema.fieldNames() == SNAPSHOT_SCHEMA.fieldNames()
    one, two = df.orderBy("videoId").collect()
    assert (one.description, one.likeCount, one.viewCount, one.commentCount, one.region) == ("first", 50, 1000, 7, None)
    assert str(one.publishedAt) == "2023-01-01 00:00:00" and str(one.trendingDate) == "2023-01-02 00:00:00"
    assert (two.viewCount, two.commentCount, two.region, two.data_source) == (None, 8, "GB", "many_m.csv")
    strict = conform(canonicalize(rc.read_ragged_csv(spark, str(tmp_path / "daily")), extra_aliases=None)).first()
    assert strict.likeCount is None and strict.trendingDate is None


@pytest.mark.parametrize("raw,name", [
    ("id", "videoId"), ("video_id", "videoId"), ("views", "viewCount"), ("view_count", "viewCount"),
    ("like_count", "likeCount"), ("daily_rank", "rank"), ("snapshot_date", "trendingDate"), ("publish_date", "publishedAt"),
    ("publishedText", "publishedAt"), ("publishedDate", "publishedAt"), ("publish_time", "publishedAt"), ("country", "region"),
])
def test_aliases(spark, raw, name):
    assert canonicalize(spark.createDataFrame([("x",)], f"{raw} string")).columns == [name]


def test_alias_priority_and_repeats(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "videoId string, id string, publishedAt string, publish_time string")
    row = canonicalize(df).first()
    assert (row.videoId, row.publishedAt) == ("a", "d")
    twice = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert tuple(drop_repeated_columns(twice).first()) == (1, 2)


def test_coercion(spark):
    df = spark.createDataFrame([("1,000",), ("12.9",), ("-3.7",), (None,), ("x",), ("1e3",), ("inf",), ("nan",)], "n string")
    assert [r.n for r in coerce_counts(df, ["n"]).collect()] == [0, 12, -3, 0, 0, 1000, 0, 0]
    dates = spark.createDataFrame([("2023-01-02",), ("2023-01-02T03:04:05Z",), ("3 days ago",), (None,), ("2023-01-02T03:00:00+02:00",)], "d string")
    got = [r.d and str(r.d) for r in coerce_timestamps(dates, ["d"]).collect()]
    assert got == ["2023-01-02 00:00:00", "2023-01-02 03:04:05", None, None, "2023-01-02 01:00:00"]


def test_trending_json(spark):
    body = {"items": [
        {"id": "a", "snippet": {"title": "T", "description": "D", "publishedAt": "2023-01-01T10:00:00Z"},
         "statistics": {"viewCount": "12", "commentCount": "3"}},
        {"id": "b", "snippet": {"title": "U", "description": "", "publishedAt": "bad"}, "statistics": {}}]}
    df = spark.createDataFrame([(json.dumps(body), "US"), ("{}", "GB"), ("not json", "IN")], "body string, region string")
    got = parse_trending_json(df, "body", F.col("region"), F.lit("2023-01-05")).orderBy("videoId").collect()
    assert [(r.videoId, r.viewCount, r.likeCount, r.commentCount, r["rank"], r.data_source) for r in got] == [
        ("a", 12, 0, 3, None, "api_US_2023-01-05"), ("b", 0, 0, 0, None, "api_US_2023-01-05")]
    assert got[1].publishedAt is None and str(got[0].trendingDate) == "2023-01-05 00:00:00"


def test_table_grows_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(FileNotFoundError):
        wh.append_aligned(first, path, create=False)
    wh.append_aligned(first, path)
    wh.append_aligned(spark.createDataFrame([("b", 2, 9.0, "s")], "name string, id int, junk double, data_source string"), path)
    wh.append_aligned(spark.createDataFrame([(3,)], "id long"), path)
    table = wh.read_table(spark, path)
    assert sorted(map(str, map(tuple, table.select("id", "name", "data_source").collect()))) == sorted(
        map(str, [(1, "a", None), (2, "b", "s"), (3, None, None)]))
    assert wh.read_table(spark, str(tmp_path / "nothing")) is None


def test_training_rows_and_files(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("videoId"), F.lit("t, \"x\"\ny").alias("title"), F.lit("d").alias("description"),
        F.lit("2023-01-01").alias("publishedAt"), F.lit("bad").alias("trendingDate"), F.col("id").alias("viewCount"),
        F.lit(0.5).alias("viral_score"), F.lit(1).alias("unused"),
    )
    got = wh.load_training_rows(df, 100, 50)
    assert got.count() == 50 and got.agg(F.min("viewCount")).first()[0] >= 100
    assert dict(got.dtypes)["publishedAt"] == "timestamp" and got.where("trendingDate is not null").count() == 0
    wh.export_sample(df, str(tmp_path / "s"), 10)
    back = rc.read_ragged_csv(spark, str(tmp_path / "s"))
    assert back.count() == 10 and back.columns[:5] == ["videoId", "title", "publishedAt", "viewCount", "viral_score"]
    assert back.first().title == 't, "x"\ny'
    wh.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "p"))
    assert (tmp_path / "p" / "split=train").exists()
    wh.write_predictions(df, df.limit(1), df.limit(2), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/weights")).count() == 2
    df.createOrReplaceTempView("some_view")
    assert "some_view" in {r.name for r in wh.list_tables(spark).collect()}
    assert wh.evolve_schema(df, T.StructType([T.StructField("n", T.LongType())])).columns[-1] == "n"


def test_blank_first_lines_and_names_that_differ_in_case(spark, tmp_path):
    write(tmp_path, "blank.csv", "\n  \nid,title\n1,a\n2,b\n")
    write(tmp_path, "case.csv", "id,ID,title\n3,4,c\n")
    df = rc.read_ragged_csv(spark, str(tmp_path))
    assert rows(df, "id", "title") == [("1", "a"), ("2", "b"), ("3", "c")]
    assert "ID.1" in df.columns


def test_latin_header_and_private_use_characters(spark, tmp_path):
    write(tmp_path, "latin.csv", "id,título\n1,café\n", "latin-1")
    write(tmp_path, "loose.csv", 'id,text\n1,"open  and \n2,a\\,b\n')
    df = rc.read_ragged_csv(spark, str(tmp_path))
    assert rows(df.where("`título` is not null"), "título") == [("café",)]
    assert rows(df.where("text is not null"), "text") == [('"open  and ',), ("a,b",)]


def test_counts_that_do_not_fit(spark):
    df = spark.createDataFrame([("inf",), ("nan",), ("1e30",), ("-7.9",), ("x",), (None,)], "viewCount string")
    assert [r.viewCount for r in conform(df).collect()] == [None, None, None, -7, None, None]
    assert [r.viewCount for r in coerce_counts(df, ["viewCount"]).collect()] == [0, 0, 0, -7, 0, 0]


def test_repeated_names_are_dropped_before_renaming(spark):
    df = spark.sql("SELECT 'a' AS id, 'b' AS title, 'c' AS title")
    assert canonicalize(df).collect()[0]["title"] == "b"
