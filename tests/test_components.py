"""Truncated SVD against numpy and Spark ML's PCA."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import functions as F

from trendspark.plans import components


def frame(spark, x, parts=7):
    pdf = pd.DataFrame({"id": range(len(x)), "x": x.tolist()})
    return spark.createDataFrame(pdf, "id bigint, x array<double>").repartition(parts)


def data(n=400, d=24, seed=0):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, 6)) @ (draw.normal(size=(6, d)) * np.array([[30], [20], [10], [5], [2], [1]])) + 0.01 * draw.normal(size=(n, d))


def test_leading_vectors_are_those_of_the_whole_decomposition(spark):
    x = data()
    got = components.truncated_svd(frame(spark, x), "x", 4)
    _, values, directions = np.linalg.svd(x, full_matrices=False)
    assert got.values == pytest.approx(values[:4], rel=1e-9)
    assert np.abs(np.sum(got.directions * directions[:4], axis=1)) == pytest.approx(np.ones(4), abs=1e-9)


def test_pass_is_a_qr_of_the_projected_rows(spark, monkeypatch):
    monkeypatch.setattr(components, "FAN", 2)
    x, basis = data(100, 8), np.random.default_rng(1).normal(size=(8, 3))
    r, s = components._sketch_pass(frame(spark, x, 9), basis)
    assert np.abs(r) == pytest.approx(np.abs(np.linalg.qr(x @ basis, mode="r")), rel=1e-9)
    assert s == pytest.approx((x @ basis).T @ x, rel=1e-9)


@pytest.mark.parametrize("n,d,k", [(1, 5, 3), (3, 5, 5), (50, 2, 9)])
def test_few_rows_short_vectors_and_lost_rank(spark, n, d, k):
    x = np.vstack([data(n, d), data(n, d), np.zeros((2, d))])
    got = components.truncated_svd(frame(spark, x), "x", k)
    values = np.linalg.svd(x, compute_uv=False)
    assert got.values[: len(values)] == pytest.approx(values[: len(got.values)], abs=1e-8 * values[0])
    assert len(got.values) == min(k, d)


def test_nothing_to_decompose(spark):
    with pytest.raises(ValueError):
        components.truncated_svd(frame(spark, data(5, 3)).where("id < 0"), "x", 2)
    with pytest.raises(ValueError):
        components.truncated_svd(frame(spark, data(5, 3)).withColumn("x", F.lit(None).cast("array<double>")), "x", 2)


@pytest.mark.parametrize("method,limit", [("svd", 8_192), (None, 3), ("pca", 8_192), (None, 8_192)])
def test_components_agree_with_pca_up_to_sign_and_are_saved(spark, tmp_path, monkeypatch, method, limit):
    monkeypatch.setattr(components, "LONGEST_FOR_COVARIANCE", limit)
    x = data()
    df = frame(spark, x - x.mean(axis=0)).withColumn("v", array_to_vector("x"))
    model = Pipeline(stages=[components.Components(3, "v", "c", method)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    show = lambda m: np.array([r.c for r in m.transform(df).select("id", vector_to_array("c").alias("c")).orderBy("id").collect()])
    want = show(PCA(k=3, inputCol="v", outputCol="c").fit(df))
    assert show(loaded) == pytest.approx(show(model), rel=1e-12)
    assert np.abs(show(loaded)) == pytest.approx(np.abs(want), rel=1e-6, abs=1e-7)


def test_a_failing_pca_falls_back(spark, monkeypatch):
    class Broken:
        def __init__(self, **_):
            pass

        def fit(self, _):
            raise RuntimeError("no covariance")

    x = data()
    df = frame(spark, x).withColumn("v", array_to_vector("x"))
    monkeypatch.setattr(components, "PCA", Broken)
    model = components.Components(2, "v", "c").fit(df)
    assert np.abs(model.pc.toArray()) == pytest.approx(np.abs(np.linalg.svd(x, full_matrices=False)[2][:2].T), abs=1e-8)
    with pytest.raises(RuntimeError):
        components.Components(2, "v", "c", "pca").fit(df)
