import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from trendspark.operators import embeddings
from trendspark.plans import meta
from trendspark.schema import SNAPSHOT_SCHEMA
from trendspark.session import new_folder, stage
from trendspark.streaming import ingest


def test_ingest_in_two_runs(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    raw = "video_id string, snapshot_date string, country string, view_count string"

    def land(rows):
        spark.createDataFrame(rows, raw).coalesce(1).write.mode("append").json(landing)

    def run():
        schema = spark.createDataFrame([], raw).schema
        rows = ingest.snapshot_stream(ingest.file_stream(spark, landing, schema, "json"))
        ingest.ingest_stream(
            rows, sink, progress, ["videoId", "trendingDate", "region"], "trendingDate", "2 days",
            keep=lambda df: df.where("viewCount >= 10"),
        )
        return sorted((r.videoId, r.viewCount) for r in spark.read.parquet(sink).collect())

    land([("a", "2023-01-01", "US", "100"), ("a", "2023-01-01", "US", "100"), ("b", "2023-01-01", "US", "5"),
          ("c", "2023-01-02", "GB", "30")])
    assert run() == [("a", 100), ("c", 30)]
    land([("a", "2023-01-01", "US", "100"), ("d", "2023-01-03", "US", "40")])
    assert run() == [("a", 100), ("c", 30), ("d", 40)]
    assert spark.read.parquet(sink).columns == SNAPSHOT_SCHEMA.fieldNames()


def test_coverage_drops_late_rows(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    names = "ts string, source string, v double"

    def step(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").json(landing)
        stream = ingest.file_stream(spark, landing, spark.createDataFrame([], names).schema, "json")
        stream = stream.withColumn("ts", F.to_timestamp("ts"))
        ingest.run_to_table(ingest.coverage_stream(stream, "ts", "source", "v", (0.5,), "1 hour"), sink, progress)

    step([("2023-01-01 10:00:00", "x", 0.7), ("2023-01-01 11:00:00", "x", None), ("2023-01-03 00:00:00", "x", 0.1)])
    step([("2023-01-01 12:00:00", "x", 0.9), ("2023-01-06 00:00:00", "x", 0.9)])
    got = sorted((str(r.window_start)[:10], r.total, r.with_value, r.ge_0_5) for r in spark.read.parquet(sink).collect())
    assert got == [("2023-01-01", 2, 1, 1), ("2023-01-03", 1, 1, 0)]


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("a", F.array(F.col("id").cast("float")))
    assert stage(df).dtypes == df.dtypes and sorted(stage(df).collect()) == sorted(df.collect())
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_cache_joins(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, " a b "), (3, "c"), (4, None)], "id int, text string")
    cache = spark.createDataFrame([("a b", [1.0, 3.0])], "text_key string, embedding array<float>")
    assert [r.text_key for r in embeddings.missing_keys(docs, cache).collect()] == ["c"]
    got = {r.id: r.embedding for r in embeddings.attach_embeddings(docs, cache, 2).collect()}
    assert got == {1: [1.0, 3.0], 2: [1.0, 3.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    new = spark.createDataFrame([("a b", [5.0, 5.0]), ("c", [7.0, 9.0])], "text_key string, embedding array<float>")
    merged = embeddings.upsert_cache(cache, new)
    assert {r.text_key: r.embedding for r in merged.collect()} == {"a b": [5.0, 5.0], "c": [7.0, 9.0]}
    stats = embeddings.vector_stats(merged, "embedding").where("text_key = 'c'").first()
    assert (stats.embedding_mean, stats.embedding_std) == (8.0, pytest.approx(1.0))
    scaled = {r.text_key: r.z for r in embeddings.scale_vectors(merged, "embedding", 2, "z").collect()}
    assert scaled == {"a b": [-1.0, -1.0], "c": [1.0, 1.0]}


def meta_frame(spark, n=300, dim=8):
    rng = np.random.default_rng(7)
    emb = rng.normal(size=(n, dim))
    y = 0.5 + 0.1 * emb[:, 0] + 0.02 * rng.normal(size=n)
    pdf = pd.DataFrame({"id": range(n), "e": emb.tolist(), "y": y, "p1": y + rng.normal(0, 0.1, n),
                        "p2": rng.random(n), "fold": np.arange(n) % 5, "text": "Some Title!"})
    return pdf, spark.createDataFrame(pdf)


def test_ridge_solutions_match_closed_form(spark):
    pdf, df = meta_frame(spark)
    ready, plain = meta.meta_inputs(df, ["p1", "p2"])
    table = meta.feature_stages(plain, None, 300)[0].transform(ready).withColumn(meta.LABEL, F.col("y"))
    x = pdf[["p1", "p2"]].to_numpy()
    centered = x - x.mean(0)
    want = np.linalg.solve(centered.T @ centered + 10 * np.eye(2), centered.T @ (pdf.y - pdf.y.mean()))
    weights, intercept = meta._solve_ridge(meta._fold_products(table, 5).sum(axis=0), 10.0)
    np.testing.assert_allclose(weights, want)
    fitted = meta.Ridge().fit(table)
    np.testing.assert_allclose(fitted.coefficients.toArray(), want, rtol=1e-6)
    assert fitted.intercept == pytest.approx(intercept)
    assert meta.Ridge(meta.RIDGE_ALPHAS).choose(table)[0] in meta.RIDGE_ALPHAS


def test_meta_model_chooses_predicts_and_reloads(spark, tmp_path):
    pdf, df = meta_frame(spark)
    models = {k: v for k, v in meta.candidates().items() if k in ("Ridge", "ElasticNet")}
    models["GradientBoosting"] = GBTRegressor(
        featuresCol=meta.FEATURES, labelCol=meta.LABEL, maxIter=3, maxDepth=2, seed=1)
    fitted = meta.fit_meta_model(df, "y", ["p1", "p2"], "fold", "e", 8, "text", models, folds=5)
    assert set(fitted.scores) == set(models)
    assert fitted.scores[fitted.chosen][0] == max(s for s, _ in fitted.scores.values()) > 0.9
    got = fitted.predict(df, clip=None).orderBy("id").toPandas()
    assert np.corrcoef(got.prediction, pdf.y)[0, 1] > 0.9
    assert abs(got.prediction.mean() - pdf.y.mean()) < 0.01
    fitted.save(str(tmp_path / "m"))
    again = meta.MetaModel.load(str(tmp_path / "m"), ["p1", "p2"], "e", "text").predict(df, clip=None).orderBy("id").toPandas()
    np.testing.assert_allclose(again.prediction, got.prediction)


def test_f_scores(spark):
    pdf, df = meta_frame(spark)
    got = {r.feature: r.f_score for r in meta.f_scores(df, ["p1", "p2"], "y").collect()}
    for c in ("p1", "p2"):
        r2 = np.corrcoef(pdf[c], pdf.y)[0, 1] ** 2
        assert got[c] == pytest.approx(r2 / (1 - r2) * 298)
