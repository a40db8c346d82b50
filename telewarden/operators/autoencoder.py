"""Linear sequence autoencoder: encode to the leading principal subspace, decode, score by error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.functions.vectors import as_cells, as_matrix, as_numbers, mean_squared_error
from telewarden.operators.ensemble import fixed_minmax, minmax_score, score_bounds
from telewarden.operators.pca import PcaModel, fit_pca, leading_axes
from telewarden.operators.sequence_moments import map_sequences, marked, sequence_moments, step_width
from telewarden.session import cut_lineage, small_table

ENCODING_DIM = 16


def _error_of(mean: np.ndarray, basis: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of two arrays alone, so that workers need not import what this module does."""

    def errors(sequences: np.ndarray) -> np.ndarray:
        centred = sequences - mean
        missed = centred - (centred @ basis.T) @ basis
        return np.mean(missed * missed, axis=1)

    return errors


@dataclass(frozen=True)
class SequenceAutoencoder:
    """The subspace and the error range of the training data."""

    pca: PcaModel
    low: float | None = None
    high: float | None = None

    def reconstruct(self, flat: str | Column) -> Column:
        """The decoded flat sequence."""
        mean, basis = self.pca.mean, self.pca.components

        @F.arrow_udf("array<double>")
        def decode(batch: pa.Array) -> pa.Array:
            centred = as_matrix(batch, len(mean)) - mean
            return as_cells((centred @ basis.T) @ basis + mean)

        return decode(F.col(flat) if isinstance(flat, str) else flat)

    def error(self, flat: str | Column) -> Column:
        """Mean squared reconstruction error, without shipping the decoded sequence back."""
        mean, basis = self.pca.mean, self.pca.components

        @F.arrow_udf("double")
        def residual(batch: pa.Array) -> pa.Array:
            centred = as_matrix(batch, len(mean)) - mean
            missed = centred - (centred @ basis.T) @ basis
            return as_numbers(np.mean(missed * missed, axis=1))

        return residual(F.col(flat) if isinstance(flat, str) else flat)

    def errors(self, sequences: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error of flattened sequences in rows."""
        return _error_of(self.pca.mean, self.pca.components)(sequences)

    def row_errors(self, stored: DataFrame, length: int, *, into: str = "error") -> DataFrame:
        """Error of the sequence that ends at each marked row of stored ``stretches``."""
        return map_sequences(stored, len(self.pca.mean) // length, length, _error_of(self.pca.mean, self.pca.components), into)

    def score_rows(self, stored: DataFrame, length: int, *, into: str = "s_lstm") -> DataFrame:
        """``row_errors`` by the bounds seen at fit time."""
        return self.row_errors(stored, length, into=into).withColumn(into, fixed_minmax(F.col(into), self.low, self.high))

    def score(self, df: DataFrame, flat: str = "flat", *, into: str = "s_lstm", normalizer: str = "fitted") -> DataFrame:
        raw = df.withColumn("_e", self.error(flat))
        if normalizer == "fitted":
            return raw.withColumn(into, fixed_minmax(F.col("_e"), self.low, self.high)).drop("_e")
        return minmax_score(raw, "_e", into).drop("_e")

    def to_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        bounds = small_table(spark, [(self.low, self.high)], "low double, high double")
        return {"autoencoder": self.pca.to_table(spark), "autoencoder_bounds": bounds}

    @staticmethod
    def from_tables(components: DataFrame, bounds: DataFrame) -> SequenceAutoencoder:
        b = bounds.first()
        return SequenceAutoencoder(PcaModel.from_table(components), b["low"], b["high"])


def fit_autoencoder(df: DataFrame, flat: str = "flat", encoding_dim: int = ENCODING_DIM) -> SequenceAutoencoder:
    """The best linear code of ``encoding_dim`` values, fitted from one distributed covariance."""
    model = SequenceAutoencoder(fit_pca(df, flat, encoding_dim))
    ends = score_bounds(df.select(model.error(flat).alias("e")), "e").first()
    return SequenceAutoencoder(model.pca, ends["lo"], ends["hi"])


def fit_autoencoder_on_rows(stored: DataFrame, length: int, encoding_dim: int = ENCODING_DIM) -> SequenceAutoencoder:
    """The same code from the marked rows of ``sequence_moments.stretches``, without building their sequences; none at all are an error."""
    _, mean, covariance = sequence_moments(stored, step_width(stored), length)
    model = SequenceAutoencoder(leading_axes(mean, covariance, encoding_dim))
    ends = score_bounds(model.row_errors(stored, length, into="e"), "e").first()
    return SequenceAutoencoder(model.pca, ends["lo"], ends["hi"])


def train_autoencoder_on_rows(stored: DataFrame, length: int, is_train: Column, encoding_dim: int = ENCODING_DIM) -> tuple[SequenceAutoencoder, DataFrame]:
    """Fit on stretches whose sequences end in ``is_train`` rows, by kept columns; also report rows and errors per split."""
    _, mean, covariance = sequence_moments(marked(stored, is_train), step_width(stored), length)
    model = SequenceAutoencoder(leading_axes(mean, covariance, encoding_dim))
    split = F.when(is_train, "train").otherwise("val")
    errors = cut_lineage(model.row_errors(stored, length, into="e").where("e is not null").select(split.alias("split"), "e"), "errors")
    ends = score_bounds(errors.where("split = 'train'"), "e").first()
    return SequenceAutoencoder(model.pca, ends["lo"], ends["hi"]), _per_split(errors, "split")


def _per_split(errors: DataFrame, split: str) -> DataFrame:
    return errors.groupBy(split).agg(F.count(F.lit(1)).alias("sequences"), F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))


def train_autoencoder(sequences: DataFrame, flat: str = "flat", encoding_dim: int = ENCODING_DIM, *, split: str = "split") -> tuple[SequenceAutoencoder, DataFrame]:
    """Fit on ``train`` rows; also report rows and mean error per split."""
    model = fit_autoencoder(sequences.where(F.col(split) == "train"), flat, encoding_dim)
    return model, _per_split(sequences.select(split, model.error(flat).alias("e")), split)


def reconstruction_error(df: DataFrame, actual: str, decoded: str, *, into: str = "error") -> DataFrame:
    """Error between any two array columns."""
    return df.withColumn(into, mean_squared_error(F.col(actual), F.col(decoded)))
