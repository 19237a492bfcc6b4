"""Rows that refer to texts kept apart: same rows as with the texts in place, and no text on the way."""

import re

from pyspark.sql import functions as F

from trendspark.operators.dedup import Referred, dedup_text
from trendspark.operators.rank import Rank, add_ranks
from trendspark.plans.training import prepare_sft


def _tables(spark):
    # Ids 1 and 2 hold equal texts, id 3 none, id 5 two texts; nobody holds id 9.
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, ""), (5, "x"), (5, "y")], "doc_id int, text string")
    refs = [1, 2, 2, 3, 3, 4, 5, 5, 9, None, 9]
    rows = spark.createDataFrame([(f"k{i:02}", "t" if i % 4 else None, r) for i, r in enumerate(refs)], "k string, title string, doc_ref int")
    joined = rows.join(docs.withColumnRenamed("text", "description"), F.col("doc_ref") == F.col("doc_id"), "left")
    return rows, joined, Referred(docs, "doc_ref", "doc_id", "text")


def test_digests_keep_the_rows_that_texts_keep(spark):
    rows, joined, texts = _tables(spark)
    names = ["k", "title", "description"]
    by_text = dedup_text(joined, ["title", "description"], "k").select(*names)
    by_digest = texts.with_text(dedup_text(texts.with_digest(rows), ["title", texts.digest], "k"), "description").select(*names)
    assert sorted(map(str, by_digest.collect())) == sorted(map(str, by_text.collect()))


def test_examples_from_referred_texts_are_those_of_texts_in_place(spark):
    rows, joined, texts = _tables(spark)
    here, apart = prepare_sft(joined, "k", 0.3), prepare_sft(rows, "k", 0.3, descriptions=texts)
    assert here.columns == apart.columns and here.columns[-1] == "split"
    assert sorted(map(str, here.collect())) == sorted(map(str, apart.collect())) and apart.count() > 3


def test_no_text_is_shuffled_or_sorted_to_find_the_rows(spark):
    rows, _, texts = _tables(spark)
    plan = dedup_text(texts.with_digest(rows), ["title", texts.digest], "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Sort|Exchange|Window|BroadcastExchange)[^\n]*\btext#", plan)
    # The split reads the rows that were written, not the join again.
    split = prepare_sft(rows, "k", descriptions=texts).select("k", "split")
    assert "Window" not in split._jdf.queryExecution().executedPlan().toString()


def test_the_hash_of_ties_travels_as_bytes(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).alias("v"))
    ranked = add_ranks(df, [Rank("v", "r", "ordinal")], tie_key=["id"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(md5(" in plan
    rows = ranked.withColumn("h", F.md5(F.concat(F.lit("42|"), F.col("id").cast("string")))).collect()
    assert [x.id for x in sorted(rows, key=lambda x: x.r)] == [x.id for x in sorted(rows, key=lambda x: (x.v, x.h))]
