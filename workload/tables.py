"""Input tables of the registered queries, derived from the given Parquet tables.

``FIXTURES.md`` describes the mapping. The snapshots, the scored table and the predictions are
written once per session and folder, as a warehouse would hold them, and read by the queries that
start from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trendspark.functions.hashing import uniform
from trendspark.operators.dedup import Referred
from trendspark.plans.score import clean_and_score
from trendspark.session import stage

# Stands in for the run clock where a snapshot has no trending date.
NOW = "2001-12-01 00:00:00"
AS_OF = "2001-12-01"
LINE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    "l_shipdate",
)
KEEP = tuple(f"NATION_{i}" for i in range(15))

_built: dict[tuple[str, str, str], DataFrame] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf, f"read {name}")
    if key not in _built:
        _built[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _built[key]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def map_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot rows, mapped from orders and their lines."""
    # The lines, by far the most rows, are dealt out once, by order and still narrow; the join with the orders reuses that.
    lines = read(spark, sf, "lineitem").select(*LINE).repartition("l_orderkey")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf, "nation").select("n_nationkey", "n_name")
    parts = read(spark, sf, "part").select("p_partkey", "p_name")
    documents = read(spark, sf, "documents")
    # Orders find their nation before they meet their lines, which then need not travel for it.
    placed = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    dated = orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "n_name")
    joined = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    n_docs = documents.agg(F.count("*").alias("n")).scalar()
    key = F.md5(
        F.concat_ws(
            "|",
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
            F.col("l_quantity").cast("bigint").cast("string"),
            F.to_date("l_shipdate").cast("string"),
        )
    )
    line = F.col("l_linenumber")
    return joined.select(
        key.alias("snapshot_key"),
        F.concat(F.lit("v"), (F.col("l_partkey") % 200).cast("string")).alias("videoId"),
        F.when(line != 5, F.col("p_name")).alias("title"),
        (F.col("l_partkey") % n_docs).alias("doc_ref"),
        F.col("o_orderdate").cast("timestamp").alias("publishedAt"),
        F.when(line != 7, F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("trendingDate"),
        F.when(F.col("n_name") != "NATION_7", F.col("n_name")).alias("region"),
        F.floor("l_extendedprice").cast("bigint").alias("viewCount"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("bigint").alias("likeCount"),
        F.col("l_quantity").cast("bigint").alias("commentCount"),
        F.when(line != 6, F.col("l_quantity").cast("bigint")).alias("rank"),
        F.concat(F.lit("src_"), "l_returnflag").alias("source"),
        F.concat(F.lit("src_"), "l_returnflag", F.lit("_"), "l_linestatus").alias("data_source"),
    )


def descriptions(spark: SparkSession, sf: str) -> Referred:
    """The descriptions the rows refer to, kept apart from them."""
    return Referred(read(spark, sf, "documents"), "doc_ref", "doc_id", "text")


def with_texts(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Add the description a row refers to."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("description"))
    return df.join(texts, F.col("doc_ref") == F.col("_doc"), "left").drop("_doc")


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        _built[key] = stage(build(), name)
    return _built[key]


def snapshots(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    """The snapshot table; ``texts`` adds the description, by far its widest column."""
    # The lines are dealt out before the joins: the wide rows are written where they are.
    table = _once(spark, sf, "snapshots", lambda: map_snapshots(spark, sf))
    return with_texts(spark, sf, table) if texts else table


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned and scored snapshots."""
    return _once(
        spark, sf, "scored",
        lambda: clean_and_score(snapshots(spark, sf), now(), "snapshot_key", ["snapshot_key"], KEEP),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with three noisy predictions: (id, lang, fold, y, p1, p2, p3)."""

    def build() -> DataFrame:
        langs = read(spark, sf, "documents").select(F.col("doc_id").alias("_doc"), "lang")
        base = scored(spark, sf).select(
            F.col("snapshot_key").alias("id"), "doc_ref", F.round("viral_score", 6).alias("y")
        )
        base = base.join(langs, F.col("doc_ref") == F.col("_doc"), "left")

        def noisy(name: str, width: float) -> Column:
            moved = F.col("y") + (uniform("id", name) - F.lit(0.5)) * F.lit(2 * width)
            return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6).alias(name)

        fold = F.floor(uniform("id", "fold") * 5).cast("int").alias("fold")
        return base.select("id", "lang", fold, "y", noisy("p1", 0.15), noisy("p2", 0.2), noisy("p3", 0.3))

    return _once(spark, sf, "predictions", build)


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows: (ex_id, prompt, response, score, split)."""
    talk = read(spark, sf, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    told = talk.where("role = 'assistant'").select(
        F.col("conv_id").alias("_conv"), (F.col("turn") - 1).alias("_turn"), F.col("text").alias("response")
    )
    pairs = asked.join(told, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")))
    pairs = pairs.withColumn("ex_id", F.concat_ws("-", "conv_id", "turn"))
    return pairs.select(
        "ex_id", "prompt", "response",
        F.round(uniform("ex_id", "score"), 6).alias("score"),
        F.when(uniform("ex_id", "split") < 0.1, "test").otherwise("train").alias("split"),
    )
