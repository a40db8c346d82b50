"""Score normalisation, fusion, detection and explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.vectors import clip01, known
from telewarden.operators.cleaning import one_row

SCORE_COLUMNS = {"lstm": "s_lstm", "isolation_forest": "s_if", "gnn": "s_gnn"}


def score_bounds(df: DataFrame, raw: str) -> DataFrame:
    return df.agg(F.min(known(F.col(raw))).alias("lo"), F.max(known(F.col(raw))).alias("hi"))


def minmax_score(df: DataFrame, raw: str, into: str, *, bounds: DataFrame | None = None, invert: bool = False) -> DataFrame:
    """Scale ``raw`` to [0, 1]; equal bounds give 0.

    Without ``bounds`` they are those of ``df`` itself, which makes a score depend on its
    batch. Streams must pass bounds frozen at fit time.
    """
    b = one_row(bounds if bounds is not None else score_bounds(df, raw))
    return df.withColumn(into, _bounded(F.col(raw), b["lo"], b["hi"], invert))


def fixed_minmax(raw: Column, lo: float, hi: float, *, invert: bool = False) -> Column:
    """The same with bounds known as numbers, for streams."""
    return _bounded(raw, F.lit(float(lo)), F.lit(float(hi)), invert)


def _bounded(raw: Column, lo: Column, hi: Column, invert: bool) -> Column:
    raw = known(raw)
    part = (hi - raw) if invert else (raw - lo)
    return F.when(raw.isNotNull(), F.when(hi > lo, clip01(part / (hi - lo))).otherwise(F.lit(0.0)))


def align_scores(lstm: DataFrame, forest: DataFrame, graph: DataFrame, on: Sequence[str]) -> DataFrame:
    """Three score tables side by side per sample."""
    return lstm.join(forest, list(on)).join(graph, list(on))


def fuse_scores(df: DataFrame, weights: Mapping[str, float] | None = None, *, into: str = "score", allow_missing: bool = False) -> DataFrame:
    """Weighted sum of the model scores, clipped to [0, 1].

    A null or NaN model score makes the result null. With ``allow_missing`` the remaining
    weights are rescaled instead and ``missing_models`` names what was absent.
    """
    weights = dict(weights or schemas.ENSEMBLE_WEIGHTS)
    scores = {m: known(F.col(SCORE_COLUMNS[m])) for m in weights}
    terms = [F.lit(float(w)) * scores[m] for m, w in weights.items()]
    if not allow_missing:
        return df.withColumn(into, clip01(sum(terms[1:], terms[0])))
    present = [F.when(scores[m].isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in weights.items()]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    weight = sum(present, F.lit(0.0))
    absent = F.array_compact(F.array(*[F.when(scores[m].isNull(), F.lit(m)) for m in weights]))
    return df.withColumns({into: F.when(weight > 0, clip01(total * F.lit(float(sum(weights.values()))) / weight)), "missing_models": absent})


def detect(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, score: str = "score") -> DataFrame:
    """Add the inclusive anomaly flag; null for a missing score."""
    return df.withColumn("is_anomaly", known(F.col(score)) >= threshold)


def score_summary(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, score: str = "score", weight: str | None = None) -> DataFrame:
    """Counts, range, mean and deviation of the known scores; ``weight`` says how many rows a row stands for."""
    s = known(F.col(score))
    if weight is None:
        count, mean, std = F.count_if, F.avg(s), F.stddev_pop(s)
    else:
        w = F.when(s.isNotNull(), F.col(weight))
        centre = df.agg(F.try_divide(F.sum(s * w), F.sum(w))).scalar()  # first, as a difference of squares would lose digits
        count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("long")
        mean, std = F.try_divide(F.sum(s * w), F.sum(w)), F.sqrt(F.try_divide(F.sum((s - centre) * (s - centre) * w), F.sum(w)))
    return df.agg(
        count(F.lit(True)).alias("samples"),
        count(s >= threshold).alias("anomalies"),
        count(s < threshold).alias("normals"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        mean.alias("mean"),
        std.alias("std"),
    )


def explain(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Per row: score, weight and contribution of each model, fused score, flag and strongest model."""
    weights = dict(weights or schemas.ENSEMBLE_WEIGHTS)
    parts = {}
    for model, column in SCORE_COLUMNS.items():
        short = column.removeprefix("s_")
        parts[f"{short}_weight"] = F.lit(float(weights[model]))
        parts[f"{short}_contribution"] = known(F.col(column)) * F.lit(float(weights[model]))
    out = detect(fuse_scores(df, weights).withColumns(parts), threshold)
    names = [c.removeprefix("s_") for c in SCORE_COLUMNS.values()]
    most = F.greatest(*[F.col(f"{n}_contribution") for n in names])
    return out.withColumn("top_model", F.coalesce(*[F.when(F.col(f"{n}_contribution") == most, F.lit(n)) for n in names]))
