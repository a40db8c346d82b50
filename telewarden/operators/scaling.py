"""Column scalers: fit gives a one-row parameter table, transform applies it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden.functions.quantiles import IN_MEMORY, quantile_table
from telewarden.operators.cleaning import fill_mean, fit_means, flag_iqr, iqr_bounds, nan_to_null, one_row, remove_outliers, settled


def _pair(centre: Column, scale: Column, name: str) -> Column:
    return F.struct(centre.alias("centre"), F.when(scale == 0.0, F.lit(1.0)).otherwise(scale).alias("scale")).alias(name)


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard", *, in_memory: int = IN_MEMORY) -> DataFrame:
    """``(centre, scale)`` per column over known cells; a zero scale becomes 1. Any other ``kind`` is robust scaling."""
    df = nan_to_null(df, cols)
    if kind == "standard":
        return df.agg(*[_pair(F.avg(c), F.stddev_pop(c), c) for c in cols])
    if kind == "minmax":
        return df.agg(*[_pair(F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double"), c) for c in cols])
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], in_memory)
    return q.select(*[_pair(F.col(c)[1], F.col(c)[2] - F.col(c)[0], c) for c in cols])


def scale(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    fitted = one_row(params)
    df = nan_to_null(df, cols)
    return df.withColumns({c: (F.col(c) - fitted[c]["centre"]) / fitted[c]["scale"] for c in cols})


def fit_scale(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> DataFrame:
    return scale(df, cols, fit_scaler(df, cols, kind))


def preprocess(
    df: DataFrame,
    cols: Sequence[str],
    *,
    outliers: bool = True,
    normalize: bool = True,
    kind: str = "standard",
    components: float | int | None = None,
) -> DataFrame:
    """Fill with means, drop outlier rows, scale, optionally reduce to ``features`` by PCA.

    What a step fits is settled before the next one, so the plan grows with the columns, not with their square.
    """
    out = fill_mean(df, cols, settled(fit_means(df, cols)))
    if outliers:
        out = remove_outliers(flag_iqr(out, cols, settled(iqr_bounds(out, cols))))
    if normalize:
        out = scale(out, cols, settled(fit_scaler(out, cols, kind)))
    if components is not None:
        from telewarden.operators.pca import fit_pca

        vectors = out.withColumn("features", F.array(*[F.col(c) for c in cols]))
        out = fit_pca(vectors, "features", components).project(vectors, "features", "features").drop(*cols)
    return out
