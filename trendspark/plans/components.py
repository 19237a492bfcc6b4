"""Leading components of vectors too long for a covariance matrix on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, functions as F

from ..operators.sketches import FAN, LEVELS

# Vectors up to this length go through Spark ML's PCA, whose covariance matrix (half a gigabyte here) the driver holds.
LONGEST_FOR_COVARIANCE = 8_192


@dataclass(frozen=True)
class SingularVectors:
    """``values`` in falling order and, one per row, the ``directions`` they belong to."""

    values: np.ndarray
    directions: np.ndarray


def _sketch_pass(rows: DataFrame, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One scan: R of the QR decomposition of X basis, and (X basis)' X.

    Tall and skinny: each task folds its rows batch by batch into one R and one sum, FAN of which at a time
    become one. Both are small, their sides being the columns of ``basis`` and the length of a vector.
    """
    width, length = basis.shape[1], basis.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    schema = "task bigint, r array<double>, s array<double>"

    def fold(r: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, more]), mode="r")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, s, number = np.zeros((0, width)), np.zeros((width, length)), None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                y = x @ shared.value
                r, s, number = fold(r, y), s + y.T @ x, batch["task"].iloc[0]
        if number is not None:
            yield pd.DataFrame({"task": [number], "r": [r.ravel()], "s": [s.ravel()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r, s = np.zeros((0, width)), np.zeros(width * length)
        for _, part in group.sort_values("task").iterrows():
            r, s = fold(r, np.reshape(part["r"], (-1, width))), s + part["s"]
        return pd.DataFrame({"task": [key[0]], "r": [r.ravel()], "s": [s]})

    level = rows.withColumn("task", F.spark_partition_id().cast("bigint")).mapInPandas(task, schema)
    for _ in range(LEVELS):
        level = level.groupBy(F.expr(f"task div {FAN}").alias("up")).applyInPandas(merge, schema)
    parts = level.collect()
    if not parts:
        raise ValueError("no vectors")
    r, s = np.zeros((0, width)), np.zeros(width * length)
    for part in sorted(parts, key=lambda p: p["task"]):
        r, s = fold(r, np.reshape(part["r"], (-1, width))), s + np.asarray(part["s"])
    return r, s.reshape(width, length)


def truncated_svd(df: DataFrame, col: str, k: int, oversample: int = 10, iterations: int = 2, seed: int = 42) -> SingularVectors:
    """The ``k`` leading singular vectors of the rows of ``col`` (an array column), by a randomised range finder.

    The rows are projected on k + ``oversample`` random directions; the range of that, made orthogonal by a tall and
    skinny QR, holds nearly all that the leading directions hold, more so after each power ``iteration``, which is one more scan. With
    as many directions as the vectors are long the result is exact. Null vectors are left out; vectors must be equally long.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("no vectors")
    length = len(first["x"])
    width = min(k + oversample, length)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(length, width)))[0]
    for turn in range(iterations + 1):
        r, s = _sketch_pass(rows, basis)
        within = np.linalg.pinv(r).T @ s  # the vectors in the orthogonal basis of the range
        if turn < iterations:
            basis = np.linalg.qr(within.T)[0]
    _, values, directions = np.linalg.svd(within, full_matrices=False)
    return SingularVectors(values[:k], directions[:k])


class Components(Estimator):
    """The ``k`` leading components of a vector column, as a Spark ML model that can be saved.

    ``method``: "pca" (Spark ML, covariance on the driver), "svd" (``truncated_svd``), or None: PCA up to
    LONGEST_FOR_COVARIANCE, SVD beyond and where PCA fails. Neither centres its input.
    """

    def __init__(self, k: int, inputCol: str, outputCol: str, method: str | None = None):
        super().__init__()
        self.k, self.input, self.output, self.method = k, inputCol, outputCol, method

    def _fit(self, dataset: DataFrame) -> PCAModel:
        pca = PCA(k=self.k, inputCol=self.input, outputCol=self.output)
        if self.method == "pca":
            return pca.fit(dataset)
        arrays = dataset.select(vector_to_array(self.input).alias("x"))
        first = arrays.where("x is not null").first()
        if self.method is None and first is not None and len(first["x"]) <= LONGEST_FOR_COVARIANCE:
            try:
                return pca.fit(dataset)
            except Exception as error:  # the driver's libraries raise errors of many kinds
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
        found = truncated_svd(arrays, "x", self.k)
        energy = found.values ** 2
        context = dataset.sparkSession.sparkContext
        matrix = DenseMatrix(found.directions.shape[1], len(found.values), found.directions.ravel().tolist())
        shares = DenseVector(energy / energy.sum() if energy.sum() else energy)
        model = PCAModel(context._jvm.org.apache.spark.ml.feature.PCAModel(self.uid, _py2java(context, matrix), _py2java(context, shares)))
        model._resetUid(self.uid)
        return model._set(k=len(found.values), inputCol=self.input, outputCol=self.output)
