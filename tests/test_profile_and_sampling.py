from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendspark.functions.hashing import key_hash
from trendspark.operators import blend, profile, sampling
from trendspark.operators.dedup import dedup_keep_last, dedup_text, duplicate_count
from trendspark.operators.filters import filter_quality, filter_recent, filter_regions, filter_score
from trendspark.plans.training import fix_bias, prepare_regression, prepare_sft
from trendspark.schema import BALANCE_EDGES, DECILE_EDGES


@pytest.mark.parametrize("closed,lo,hi", [("left", True, False), ("right", False, True), ("numpy", True, True)])
def test_bin_edges(spark, closed, lo, hi):
    edges = DECILE_EDGES
    values = sorted({v for e in edges for v in (e - 1e-9, e, e + 1e-9)}) + [None, -1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(profile.bin_index(F.col("v"), edges, closed)).collect()]
    clean = pd.Series(values[:-3])
    if closed == "numpy":
        want = [int(np.histogram([v], edges)[0].argmax()) if np.histogram([v], edges)[0].sum() else None for v in clean]
    else:
        want = [None if pd.isna(c) else int(c) for c in pd.cut(clean, edges, labels=False, right=closed == "right")]
    assert got == want + [None, None, None]
    counts = profile.histogram(df, "v", edges, closed).agg(F.sum("count")).first()[0]
    assert counts == sum(w is not None for w in want)


def test_describe_and_correlations(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 0.0], "b": [0.0, 0.0, 1.0, 5.0, 2.0], "c": [1.0] * 5})
    df = spark.createDataFrame(pdf)
    rows = {r.metric: r for r in profile.describe_metrics(df, list("abc")).collect()}
    for c in "abc":
        d = pdf[c].describe()
        assert [rows[c][k] for k in ("mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(d[1:]))
        assert rows[c].null_pct == pytest.approx(100 * pdf[c].isna().mean())
        assert rows[c].zero_pct == pytest.approx(100 * (pdf[c] == 0).mean())
    corr = {(r.metric_a, r.metric_b): r.corr for r in profile.correlation_matrix(df, list("abc")).collect()}
    assert corr["a", "b"] == pytest.approx(pdf.a.corr(pdf.b))
    assert corr["a", "c"] is None and corr["b", "b"] == pytest.approx(1.0)


def test_dataset_checks(spark):
    rows = [("p", "same response" if i < 150 else f"response number {i}", "train") for i in range(1100)]
    rows += [(" ", "x", "train"), ("p", "", "test")]
    df = spark.createDataFrame(rows, "prompt string, response string, split string")
    got = {r.check: (r.value, r.ok) for r in profile.dataset_checks(df).collect()}
    assert got["train_rows"] == (1101.0, True)
    assert got["empty_prompts"] == (1.0, False)
    assert got["empty_responses"] == (0.0, True)
    assert got["top_response"] == (150.0, False)
    assert got["short_responses"] == (1.0, True)
    assert got["test_rows"] == (1.0, True)


def test_label_bias(spark):
    df = spark.createDataFrame([(0.20001,)] * 4 + [(0.3,)] * 6, "s double")
    top = profile.label_bias(df, "s").collect()
    assert [(r.label, r.n, r.biased) for r in top] == [(0.3, 6, True), (0.2, 4, True)]


def test_filters(spark):
    df = spark.createDataFrame(
        [("US", "t", "d", "2020-01-01", 100, 0.9), (None, "t", None, "2020-01-01", 500, 0.95),
         ("IN", None, "d", None, 99, 0.1), ("DE", "t", "d", None, 100, 0.8)],
        "region string, title string, description string, publishedAt string, viewCount long, viral_score double",
    ).withColumn("publishedAt", F.to_timestamp("publishedAt"))
    assert [r.region for r in filter_regions(df).collect()] == ["US", None, "DE"]
    assert [r.region for r in filter_quality(df).collect()] == ["US"]
    assert [r.region for r in filter_score(df, 0.8).collect()] == ["US", "DE"]
    assert filter_recent(df, 1, "2020-12-31").count() == 4
    assert filter_recent(df, 1, "2021-01-02").count() == 2
    assert filter_recent(df, 1, "2021-01-02", keep_null=False).count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 3), ("a", "x", 2), (None, None, 5), (None, None, 4)], "k string, l string, o int")
    assert sorted(r.o for r in dedup_keep_last(df, ["k", "l"], "o").collect()) == [2, 3, 5]
    assert sorted(r.o for r in dedup_text(df, ["k", "l"], "o").collect()) == [1, 2, 4]
    c = duplicate_count(df, ["k", "l"]).first()
    assert (c.n_rows, c.n_distinct, c.n_duplicates) == (5, 3, 2)


def hashed(spark, n):
    return spark.range(n).withColumn("s", (F.col("id") % 97) / F.lit(96.0))


def test_sample_is_the_first_n_hashes(spark):
    df = hashed(spark, 5000)
    for n in (0, 1, 777, 5000, 6000):
        got = {r.id for r in sampling.sample_n(df.repartition(3), n, ["id"]).collect()}
        want = {r.id for r in df.orderBy(key_hash("id")).limit(n).collect()}
        assert got == want


def test_stratified_cap_and_rebalance(spark):
    df = hashed(spark, 4000)
    capped = sampling.stratified_cap(df, "s", DECILE_EDGES, 300, ["id"], closed="right")
    bins = capped.withColumn("b", profile.bin_index(F.col("s"), DECILE_EDGES, "right")).groupBy("b").count().collect()
    whole = {r.b: r["count"] for r in df.withColumn("b", profile.bin_index(F.col("s"), DECILE_EDGES, "right")).groupBy("b").count().collect() if r.b is not None}
    assert {r.b: r["count"] for r in bins} == {b: min(c, 300) for b, c in whole.items()}
    even = sampling.rebalance(df, "s", ["id"], dominant=0.15, cap=500, at_least=100)
    pdf = df.toPandas()
    cut = pd.cut(pdf.s, BALANCE_EDGES, right=False, labels=False)
    want = 0
    for _, c in Counter(cut.dropna()).items():
        want += int(4000 * 0.15) if c > 4000 * 0.15 else min(max(min(c, 500), 100), c)
    assert even.count() == want


def test_splits(spark):
    df = hashed(spark, 1001)
    parts = {r.split: r["count"] for r in sampling.train_test_split(df, 0.1, ["id"]).groupBy("split").count().collect()}
    assert parts == {"test": 101, "train": 900}
    grouped = sampling.train_test_split(df, 0.3, ["s"], exact=False).groupBy("s").agg(F.countDistinct("split").alias("n"))
    assert grouped.where("n > 1").count() == 0
    tail = sampling.tail_holdout(df, 0.1, "id", ["id"]).where("holdout").agg(F.min("id"), F.count("*")).first()
    assert (tail[0], tail[1]) == (900, 101)


def test_bin_noise(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.2, 0.2, 0.5, 1.0, 0.049])], "id int, s double")
    got = sampling.bin_noise(df, "s", ["id"]).orderBy("id").toPandas().s
    assert got[4] == 1.0
    assert (got[1:3] <= 0.2 + 1e-4).all() and (got[1:3] >= 0.2 - 0.3 * 0.005).all()
    assert abs(got[3] - 0.5) <= 0.3 * 0.75 + 1e-4
    assert ((got >= 0) & (got <= 1)).all()


def test_weighted_resample(spark):
    df = spark.createDataFrame([(i, 1000.0 if i == 3 else 1.0 if i % 2 else 0.0) for i in range(200)], "id int, w double")
    drawn = sampling.weighted_resample(df, "w", 3000, ["id"]).toPandas()
    assert len(drawn) == 3000 and drawn.draw.nunique() == 3000
    counts = Counter(drawn.id)
    assert all(i % 2 for i in counts)
    assert abs(counts[3] / 3000 - 1000 / 1099) < 0.02
    again = sampling.weighted_resample(df.repartition(7), "w", 3000, ["id"]).toPandas()
    assert sorted(zip(drawn.draw, drawn.id)) == sorted(zip(again.draw, again.id))
    assert sampling.weighted_resample(df, "w", None, ["id"]).count() == 200


def test_inverse_weights_count_missing_as_one_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "l string")
    got = sorted(r.weight for r in sampling.inverse_freq_weight(df, "l").collect())
    assert got == pytest.approx([1 / 3, 1 / 3, 1 / 2])


def test_blend_search(spark):
    rng = np.random.default_rng(6)
    y = rng.beta(2, 5, 400)
    pdf = pd.DataFrame({"id": range(400), "y": y, "a": np.clip(y + rng.normal(0, 0.15, 400), 0, 1),
                        "b": np.clip(y + rng.normal(0, 0.2, 400), 0, 1), "c": rng.random(400)})
    df = spark.createDataFrame(pdf)
    grid = blend.grid_search_blend(df, "a", "b", "y").toPandas().sort_values("grid_id")
    want = [pdf.y.rank().corr(((1 - i / 20) * pdf.a + i / 20 * pdf.b).rank()) for i in range(21)]
    np.testing.assert_allclose(grid.spearman, want, atol=1e-9)
    best = blend.best_blend(blend.grid_search_blend(df, "a", "b", "y")).first()
    assert best.grid_id == int(np.argmax(want))
    vectors = blend.simplex_weights(3)
    assert len(vectors) == 66 and all(sum(v) == pytest.approx(1) and min(v) >= 0 for v in vectors)
    found = blend.simplex_search(df, ["a", "b", "c"], "y").toPandas().sort_values("grid_id")
    want = [pdf.y.rank().corr((v[0] * pdf.a + v[1] * pdf.b + v[2] * pdf.c).rank()) for v in vectors]
    np.testing.assert_allclose(found.spearman, want, atol=1e-6)
    turned = blend.fix_inversion(df.withColumn("q", 1 - F.col("a")), "y", "q", "f").toPandas().sort_values("id")
    np.testing.assert_allclose(turned.f, pdf.a)
    final = blend.final_blend(df, "a", "b", ["id"], clip="linear", margin=0.05).toPandas().sort_values("id")
    ra, rb = (pdf.a.rank(method="first") - 1) / 399, (pdf.b.rank(method="first") - 1) / 399
    ok = ~(pdf.a.duplicated(False) | pdf.b.duplicated(False))
    np.testing.assert_allclose(final.final[ok.values], np.clip((0.4 * ra + 0.6 * rb - 0.05) / 0.9, 0, 1)[ok])
    report = {r.model: r for r in blend.blend_report(df, "y", ["a", "c"]).collect()}
    assert report["a"].mse == pytest.approx(((pdf.y - pdf.a) ** 2).mean())
    assert report["c"].spearman == pytest.approx(pdf.y.rank().corr(pdf.c.rank()))


def test_training_sets(spark):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("videoId"),
        F.concat(F.lit("t"), F.col("id") % 1500).alias("title"),
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("  d"), F.col("id") % 1500)).alias("description"),
        ((F.col("id") % 100) / F.lit(100.0)).alias("viral_score"),
    )
    sft = prepare_sft(df, "k")
    assert sft.count() == 1350
    assert sft.where("split = 'test'").count() == 135
    row = sft.where("title = 't1'").first()
    assert row.response == "t1\nDescription: d1" and row.prompt.endswith("Title:")
    reg = prepare_regression(df, "k", per_bucket=50)
    assert 0 < reg.count() <= 9 * 50
    fixed = fix_bias(reg, ["k"])
    assert fixed.where("split = 'test'").count() == reg.where("split = 'test'").count()


@pytest.mark.parametrize("weights", [[1e-13] * 1000, [9000.0] * 1000, [1e15] * 1000])
def test_resample_reaches_all_rows_whatever_the_unit(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "id bigint, w double")
    drawn = sampling.weighted_resample(df, "w", 20_000, ["id"]).toPandas()
    assert len(drawn) == 20_000 and drawn.id.nunique() == 1000


def test_resample_of_mixed_weights(spark):
    rows = [(i, 1e6) for i in range(10)] + [(10 + i, 3e6) for i in range(10)] + [(30, 1e-9), (31, 0.0), (32, -1.0), (33, None), (34, float("nan"))]
    df = spark.createDataFrame(rows, "id bigint, w double")
    drawn = sampling.weighted_resample(df, "w", 40_000, ["id"]).toPandas()
    assert set(drawn.id) == set(range(20))
    assert (drawn.id >= 10).mean() == pytest.approx(0.75, abs=0.01)
    for bad in ([0.0, None], [float("inf")]):
        with pytest.raises(ValueError):
            sampling.weighted_resample(spark.createDataFrame([(1, x) for x in bad], "id bigint, w double"), "w", 5, ["id"])
