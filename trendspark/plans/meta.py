"""The stacked meta-model: features from base predictions and embeddings, model choice, prediction."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.clipping import clipped
from ..functions.text import text_features
from ..operators.evaluate import safe_corr, spearman
from ..operators.normalize import union_sources
from ..session import stage
from .components import Components

FEATURES = "meta_features"
LABEL = "_label"

# Regularisation strengths tried by the cross-validated ridge model.
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 50.0, 100.0)


def meta_inputs(
    df: DataFrame, predictions: Sequence[str], embedding: str | None = None, text: str | None = None
) -> tuple[DataFrame, list[str]]:
    """The frame with the embedding as a vector and, if asked, the text features as columns.

    Returns it with the names of the columns that go into the features unchanged.
    """
    plain = list(predictions)
    ready = df
    if embedding is not None:
        ready = ready.withColumn("_emb", array_to_vector(F.col(embedding).cast("array<double>")))
    if text is not None:
        feats = text_features(F.col(text))
        ready = ready.withColumns({f"_tf_{k}": v.cast("double") for k, v in feats.items()})
        plain += [f"_tf_{k}" for k in feats]
    return ready, plain


def feature_stages(
    plain: Sequence[str], dim: int | None, n_rows: int, components: int = 30, top: int = 40
) -> list[Estimator]:
    """Scaling, principal components, assembly and the choice of the ``top`` features by F-test.

    Components are computed only if ``dim``, the length of the embedding, is given: by PCA, or by a
    truncated SVD where the vectors are too long for it.
    """
    if dim is None:
        return [VectorAssembler(inputCols=list(plain), outputCol=FEATURES)]
    k = min(components, dim, n_rows - 1)
    selector = UnivariateFeatureSelector(
        featuresCol="_all", outputCol=FEATURES, labelCol=LABEL, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("continuous")
    selector.setSelectionThreshold(min(top, len(plain) + k))
    return [
        StandardScaler(inputCol="_emb", outputCol="_scaled", withMean=True, withStd=True),
        Components(k, "_scaled", "_pca"),
        VectorAssembler(inputCols=[*plain, "_pca"], outputCol="_all"),
        selector,
    ]


def _fold_products(df: DataFrame, folds: int) -> np.ndarray:
    """For each of ``folds`` keyed parts of the rows the matrix Z'Z of Z = (1, features, label).

    One pass: each task adds up its rows, Spark adds up the tasks. What reaches the driver are
    ``folds`` matrices whose size is set by the number of features.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.empty((0, 0))
            z = np.column_stack([np.ones(len(batch)), x, batch["y"]]) if len(batch) else x
            for part in np.unique(batch["part"]):
                rows = z[(batch["part"] == part).to_numpy()]
                sums[int(part)] = sums.get(int(part), 0.0) + rows.T @ rows
        for part, total in sums.items():
            yield pd.DataFrame({"part": [part], "m": [total.ravel()]})

    rows = df.select(
        F.pmod(F.xxhash64(FEATURES), F.lit(folds)).cast("int").alias("part"),
        vector_to_array(FEATURES).alias("x"),
        F.col(LABEL).alias("y"),
    )
    partial = rows.mapInPandas(products, "part int, m array<double>")
    cells = partial.select("part", F.posexplode("m").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
    found = cells.toPandas()
    side = int(round((int(found["at"].max()) + 1) ** 0.5))
    out = np.zeros((folds, side * side))
    out[found["part"].to_numpy(), found["at"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(folds, side, side)


def _solve_ridge(m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the ridge regression on the rows summed up in ``m``."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    centered = m - n * np.outer(mean, mean)
    weights = np.linalg.solve(centered[1:-1, 1:-1] + alpha * np.eye(len(m) - 2), centered[1:-1, -1])
    return weights, mean[-1] - mean[1:-1] @ weights


def _r2(m: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """Share of variance explained on the rows summed up in ``m``."""
    w = np.concatenate([[-intercept], -weights, [1.0]])
    spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return 1.0 - float(w @ m @ w) / spread if spread > 0 else 0.0


@dataclass
class Ridge:
    """Ridge regression: least squared error plus strength times squared weights.

    Of several ``alphas`` the best by mean R2 over ``folds`` folds is taken. All folds and strengths
    are solved from one pass over the rows; the chosen one is then fitted as a Spark ML model.
    """

    alphas: Sequence[float] = (10.0,)
    folds: int = 5

    def choose(self, df: DataFrame) -> tuple[float, np.ndarray]:
        """The chosen strength and the sums over all rows."""
        parts = _fold_products(df, self.folds)
        whole = parts.sum(axis=0)
        used = [m for m in parts if m[0, 0] > 1 and whole[0, 0] - m[0, 0] > 1]

        def quality(alpha: float) -> float:
            return float(np.mean([_r2(m, *_solve_ridge(whole - m, alpha)) for m in used])) if used else 0.0

        best = self.alphas[0] if len(self.alphas) == 1 else max(self.alphas, key=quality)
        return best, whole

    def fit(self, df: DataFrame) -> LinearRegressionModel:
        alpha, m = self.choose(df)
        n = m[0, 0]
        # The solver measures the penalty in deviations of the label and the error per row.
        deviation = float(np.sqrt(max(m[-1, -1] / n - (m[0, -1] / n) ** 2, 0.0)))
        return LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, regParam=alpha * deviation / n, elasticNetParam=0.0,
            standardization=False, solver="normal",
        ).fit(df)


def candidates() -> dict[str, Estimator | Ridge]:
    """The models to choose from."""
    names = {"featuresCol": FEATURES, "labelCol": LABEL, "seed": 42}
    return {
        "Ridge": Ridge(),
        "RidgeCV": Ridge(RIDGE_ALPHAS),
        "ElasticNet": LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, regParam=0.1, elasticNetParam=0.5,
            standardization=False, maxIter=1000,
        ),
        "GradientBoosting": GBTRegressor(maxIter=100, stepSize=0.05, maxDepth=3, minInstancesPerNode=10, **names),
        "RandomForest": RandomForestRegressor(numTrees=100, maxDepth=5, **names),
    }


def cross_validate(
    df: DataFrame, models: Mapping[str, Estimator | Ridge], fold_col: str, folds: int
) -> dict[str, tuple[float, float]]:
    """Per model the mean and the deviation over the folds of the Spearman correlation on the held-out fold.

    The held-out predictions of all models and folds are written as one narrow table and ranked
    together.
    """
    parts = []
    for name, model in models.items():
        for k in range(folds):
            held = model.fit(df.where(F.col(fold_col) != k)).transform(df.where(F.col(fold_col) == k))
            parts.append(held.select(F.lit(name).alias("model"), F.lit(k).alias("fold"), LABEL, "prediction"))
    table = stage(union_sources(*parts), "held_out")
    rho = spearman(table, LABEL, "prediction", ["model", "fold"], known_groups=len(parts))
    # A fold without a correlation counts as none at all.
    per_model = rho.groupBy("model").agg(
        F.avg(F.coalesce("spearman", F.lit(0.0))).alias("mean"),
        F.stddev_pop(F.coalesce("spearman", F.lit(0.0))).alias("std"),
    )
    found = {r["model"]: (r["mean"], r["std"]) for r in per_model.collect()}
    return {name: found.get(name, (float("-inf"), 0.0)) for name in models}


@dataclass
class MetaModel:
    """A fitted meta-model and the scores it was chosen by: name to (mean, deviation)."""

    pipeline: PipelineModel
    predictions: list[str]
    embedding: str | None
    text: str | None
    chosen: str = ""
    scores: dict[str, tuple[float, float]] | None = None

    def predict(self, df: DataFrame, out: str = "prediction", clip: str | None = "soft", margin: float = 0.1) -> DataFrame:
        """Add the prediction on the scale of the label, clipped."""
        ready, _ = meta_inputs(df, self.predictions, self.embedding, self.text)
        done = self.pipeline.transform(ready)
        return done.select(*df.columns, clipped(F.col("_final"), clip, margin).alias(out))

    def save(self, path: str) -> None:
        """Write the fitted stages."""
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(
        cls, path: str, predictions: Sequence[str], embedding: str | None = None, text: str | None = None
    ) -> "MetaModel":
        return cls(PipelineModel.load(path), list(predictions), embedding, text)


def fit_meta_model(
    df: DataFrame,
    label: str,
    predictions: Sequence[str],
    fold_col: str,
    embedding: str | None = None,
    dim: int | None = None,
    text: str | None = None,
    models: Mapping[str, Estimator | Ridge] | None = None,
    folds: int = 5,
) -> MetaModel:
    """Fit the features, choose the model with the best mean Spearman over ``folds``, refit it on all rows.

    ``fold_col`` holds the fold of each row, 0 to folds - 1. Labels are standardised for fitting.
    """
    ready, plain = meta_inputs(df, predictions, embedding, text)
    n, mean, std = df.agg(F.count(label), F.avg(label), F.stddev_pop(label)).first()
    labelled = ready.withColumn(LABEL, (F.col(label) - F.lit(mean)) / F.lit(std or 1.0))
    steps = feature_stages(plain, dim if embedding is not None else None, n)
    features = Pipeline(stages=steps).fit(labelled)
    # Every fold of every model reads the features, so they are computed once.
    table = stage(features.transform(labelled).select(FEATURES, LABEL, fold_col), "meta_features")

    tried = dict(models) if models is not None else candidates()
    scores = cross_validate(table, tried, fold_col, folds)
    chosen = max(scores, key=lambda name: scores[name][0])
    last = tried[chosen].fit(table)
    back = SQLTransformer(statement=f"SELECT *, prediction * {std or 1.0!r} + {mean!r} AS _final FROM __THIS__")
    whole = PipelineModel(stages=[*features.stages, last, back])
    return MetaModel(whole, list(predictions), embedding, text, chosen, scores)


def f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per feature: F statistic of its linear relation to the label, highest first."""
    n = F.count("*")
    wide = df.agg(n.alias("n"), *[safe_corr(F.col(c), F.col(label)).alias(f"r{i}") for i, c in enumerate(features)])
    rows = []
    for i, c in enumerate(features):
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        score = r2 / (F.lit(1.0) - r2) * (F.col("n") - 2)
        rows.append(F.struct(F.lit(c).alias("feature"), score.alias("f_score")))
    return wide.select(F.inline(F.array(*rows))).orderBy(F.desc_nulls_last("f_score"), "feature")
