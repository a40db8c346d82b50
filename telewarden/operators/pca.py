"""Centred principal components with a fixed sign."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.functions.vectors import is_complete, multiply
from telewarden.session import small_table


@dataclass(frozen=True)
class PcaModel:
    """``mean`` (d), ``components`` (k, d) with orthonormal rows, ``ratios`` (k). All are d by d at most."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray

    def project(self, df: DataFrame, features: str, into: str) -> DataFrame:
        shift = self.components @ self.mean
        z = multiply(F.col(features), self.components.T)
        offsets = F.array(*[F.lit(float(s)) for s in shift])
        return df.withColumn(into, F.zip_with(z, offsets, lambda a, b: a - b))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(-1, None, [float(v) for v in self.mean])] + [
            (i, float(r), [float(v) for v in c]) for i, (r, c) in enumerate(zip(self.ratios, self.components))
        ]
        return small_table(spark, rows, "component int, ratio double, vector array<double>")

    @staticmethod
    def from_table(table: DataFrame) -> PcaModel:
        """One row per component, so at most as many rows as dimensions."""
        rows = sorted(table.collect(), key=lambda r: r["component"])
        return PcaModel(
            np.array(rows[0]["vector"]), np.array([r["vector"] for r in rows[1:]]), np.array([r["ratio"] for r in rows[1:]])
        )


def fit_pca(df: DataFrame, features: str, components: float | int = 0.95) -> PcaModel:
    """Fit by a distributed covariance; only d by d values reach the driver.

    A whole number keeps that many components; a fraction keeps the fewest
    whose cumulative variance ratio exceeds it. The largest loading of each
    component is positive. Incomplete vectors are left out.
    """
    vectors = df.where(is_complete(F.col(features))).select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    d = len(mean)
    wanted = d if isinstance(components, float) else min(int(components), d)
    fitted = PCA(k=wanted, inputCol="v", outputCol="z").fit(vectors)
    return _signed(mean, fitted.pc.toArray().T, fitted.explainedVariance.toArray(), components)


def leading_axes(mean: np.ndarray, covariance: np.ndarray, components: float | int) -> PcaModel:
    """The same from a mean and a covariance that are known."""
    values, vectors = np.linalg.eigh(covariance)
    values, loadings = np.maximum(values[::-1], 0.0), vectors.T[::-1]
    if not isinstance(components, float):
        loadings = loadings[: int(components)]
    ratios = values[: len(loadings)] / (values.sum() or 1.0)
    return _signed(mean, loadings, ratios, components)


def _signed(mean: np.ndarray, loadings: np.ndarray, ratios: np.ndarray, components: float | int) -> PcaModel:
    if isinstance(components, float):
        keep = min(int(np.searchsorted(np.cumsum(ratios), components, side="right")) + 1, len(mean))
        loadings, ratios = loadings[:keep], ratios[:keep]
    strongest = np.abs(loadings).argmax(axis=1)
    signs = np.where(loadings[np.arange(len(loadings)), strongest] < 0, -1.0, 1.0)
    return PcaModel(mean, loadings * signs[:, None], ratios)
