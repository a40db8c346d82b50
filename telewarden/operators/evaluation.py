"""Exact detection metrics from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.prefix import ROWS_PER_RANGE, running_totals, value_ranges
from telewarden.functions.vectors import known
from telewarden.operators.cleaning import one_row
from telewarden.session import cut_lineage

STEPS = 100  # thresholds 0, 0.01 .. 1


def zip_labels(scores: DataFrame, labels: DataFrame, on: Sequence[str] = ("row_id",)) -> DataFrame:
    return scores.join(labels, list(on))


def zip_mismatches(scores: DataFrame, labels: DataFrame, on: Sequence[str] = ("row_id",)) -> DataFrame:
    """How many rows of each side have no partner."""
    left = scores.select(*on, F.lit(1).alias("_l"))
    right = labels.select(*on, F.lit(1).alias("_r"))
    both = left.join(right, list(on), "full")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("scores_without_label"), F.count_if(F.col("_l").isNull()).alias("labels_without_score")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Zero wherever a denominator is zero."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp),
        "f1_score": _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
    }


def score_groups(df: DataFrame, *, label: str = "y_true", score: str = "score") -> DataFrame:
    """The stored table of distinct labels and scores with their number ``n``, for measures that weigh by it. Missing ones are null."""
    grouped = df.groupBy(known(F.col(label)).alias(label), known(F.col(score).cast("double")).alias(score)).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(grouped, "score-groups")


def _count(condition: Column, weight: str | None) -> Column:
    """Rows where the condition holds, or the sum of their weights."""
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("long")


def confusion(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, label: str = "y_true", score: str = "score", weight: str | None = None) -> DataFrame:
    said, truth = known(F.col(score)) >= threshold, known(F.col(label)) == 1
    return df.agg(
        _count(said & truth, weight).alias("tp"),
        _count(said & ~truth, weight).alias("fp"),
        _count(~said & truth, weight).alias("fn"),
        _count(~said & ~truth, weight).alias("tn"),
    )


def binary_metrics(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, label: str = "y_true", score: str = "score", weight: str | None = None) -> DataFrame:
    counts = confusion(df, threshold, label=label, score=score, weight=weight)
    c = F.col
    return counts.select("*", *[v.alias(k) for k, v in _rates(c("tp"), c("fp"), c("fn"), c("tn")).items()])


def _cumulative(df: DataFrame, label: str, score: str, rows_per_range: int, weight: str | None = None) -> DataFrame:
    """Per distinct score, descending: own and running positives and negatives, ties collapsed."""
    scored = df.where(known(F.col(score)).isNotNull())
    cuts = value_ranges(scored, score, rows_per_range)
    truth = known(F.col(label))
    groups = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        _count(truth == 1, weight).alias("pos"), _count(truth != 1, weight).alias("neg")
    )
    return running_totals(groups, "threshold", ["pos", "neg"], cuts)


def _class_totals(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    scored, truth = known(F.col(score)).isNotNull(), known(F.col(label))
    return df.agg(_count(scored & (truth == 1), weight).cast("double").alias("p"), _count(scored & (truth != 1), weight).cast("double").alias("n"))


def roc_curve(df: DataFrame, *, label: str = "y_true", score: str = "score", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score, and the origin at threshold infinity."""
    totals = one_row(_class_totals(df, label, score))
    points = _cumulative(df, label, score, rows_per_range).select(
        "threshold",
        F.try_divide(F.col("cum_neg").cast("double"), totals["n"]).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), totals["p"]).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df: DataFrame, *, label: str = "y_true", score: str = "score", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``threshold, precision, recall``, and the end point (recall 0, precision 1) without a threshold."""
    totals = one_row(_class_totals(df, label, score))
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    points = _cumulative(df, label, score, rows_per_range).select(
        "threshold", (tp / (tp + fp)).alias("precision"), F.try_divide(tp, totals["p"]).alias("recall")
    )
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def curve_areas(df: DataFrame, *, label: str = "y_true", score: str = "score", rows_per_range: int = ROWS_PER_RANGE, weight: str | None = None) -> DataFrame:
    """``roc_auc`` (rank sum) and ``pr_auc`` (trapezoids) from one cumulative table; 0 if a class is absent."""
    totals = one_row(_class_totals(df, label, score, weight))
    p, n = totals["p"], totals["n"]
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    before = tp + fp - pos - neg
    last_precision = F.when(before > 0, (tp - pos) / before).otherwise(F.lit(1.0))
    rank_sum = F.sum(pos * ((n - fp) + neg / F.lit(2.0)))
    trapezoids = F.sum(pos * (tp / (tp + fp) + last_precision) / F.lit(2.0))
    sums = _cumulative(df, label, score, rows_per_range, weight).agg(rank_sum.alias("rank_sum"), trapezoids.alias("trapezoids"))
    return sums.select(
        F.coalesce(F.try_divide(F.col("rank_sum"), p * n), F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.try_divide(F.col("trapezoids"), p), F.lit(0.0)).alias("pr_auc"),
    )


def threshold_sweep(df: DataFrame, *, label: str = "y_true", score: str = "score", weight: str | None = None) -> DataFrame:
    """Counts and rates at all 101 thresholds ``i * 0.01``.

    Each row is counted once, under the highest threshold it reaches; the counts at
    a threshold are sums over the at most 102 groups.
    """
    s, truth = known(F.col(score).cast("double")), known(F.col(label))
    guess = F.floor(F.least(F.greatest(s, F.lit(-1.0)), F.lit(2.0)) * F.lit(100.0))
    step = F.lit(0.01)
    exact = F.when((guess + 1) * step <= s, guess + 1).when(guess * step > s, guess - 1).otherwise(guess)
    reached = F.least(F.greatest(exact, F.lit(-1)), F.lit(STEPS)).cast("long")
    groups = df.where(s.isNotNull()).groupBy(reached.alias("i")).agg(
        _count(truth == 1, weight).alias("pos"), _count(truth != 1, weight).alias("neg")
    )
    grid = df.sparkSession.range(-1, STEPS + 1).withColumnRenamed("id", "i")
    full = grid.join(groups, "i", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = full.select(
        "i",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("_p"),
        F.sum("neg").over(everything).alias("_n"),
    ).where("i >= 0")
    out = counted.select(
        (F.col("i") * step).alias("threshold"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")
    )
    c = F.col
    return out.select("*", *[v.alias(k) for k, v in _rates(c("tp"), c("fp"), c("fn"), c("tn")).items()])


def best_threshold(df: DataFrame, metric: str = "f1", *, label: str = "y_true", score: str = "score", weight: str | None = None) -> DataFrame:
    """The sweep row with the highest metric; the lowest threshold wins ties.

    If nothing exceeds 0 it is the row at 0.5. ``roc_auc`` does not depend on the threshold, so
    any positive area selects 0.
    """
    sweep = threshold_sweep(df, label=label, score=score, weight=weight)
    if metric == "roc_auc":
        area = curve_areas(df, label=label, score=score, weight=weight).select("roc_auc").scalar()
        value = F.when(area > 0, area).otherwise(F.lit(0.0))
    else:
        value = F.col({"precision": "precision", "recall": "recall"}.get(metric, "f1_score"))
    fallback = (value == 0) & (F.abs(F.col("threshold") - F.lit(0.5)) < 1e-9)
    return sweep.withColumn("optimized", value).orderBy(F.col("optimized").desc(), fallback.desc(), F.col("threshold")).limit(1)


def class_report(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, label: str = "y_true", score: str = "score", weight: str | None = None) -> DataFrame:
    """Precision, recall, f1 and support for Normal, Anomaly and their macro and weighted averages."""
    counts = confusion(df, threshold, label=label, score=score, weight=weight)
    c = F.col

    def per_class(hit: str, wrong: str, missed: str) -> dict[str, Column]:
        r = _rates(c(hit), c(wrong), c(missed), F.lit(0))
        return {"precision": r["precision"], "recall": r["recall"], "f1_score": r["f1_score"], "support": (c(hit) + c(missed)).cast("long")}

    normal, anomaly = per_class("tn", "fn", "fp"), per_class("tp", "fp", "fn")
    both = normal["support"] + anomaly["support"]
    rates = ("precision", "recall", "f1_score")
    macro = {k: (normal[k] + anomaly[k]) / F.lit(2.0) for k in rates} | {"support": both}
    weighted = {
        k: _ratio(normal[k] * normal["support"] + anomaly[k] * anomaly["support"], both.cast("double")) for k in rates
    } | {"support": both}
    rows = {"Normal": normal, "Anomaly": anomaly, "macro avg": macro, "weighted avg": weighted}
    structs = [F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in r.items()]) for name, r in rows.items()]
    return counts.select(F.inline(F.array(*structs)))


def dataset_stats(df: DataFrame, *, label: str = "y_true", weight: str | None = None) -> DataFrame:
    truth = known(F.col(label))
    total = F.sum(truth if weight is None else truth * F.col(weight))
    return df.agg(
        _count(F.lit(True), weight).alias("total_samples"),
        _count(truth == 0, weight).alias("normal_samples"),
        _count(truth == 1, weight).alias("anomaly_samples"),
        F.try_divide(total.cast("double"), _count(truth.isNotNull(), weight)).alias("anomaly_ratio"),
    )


def evaluation_report(df: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD, *, label: str = "y_true", score: str = "score") -> DataFrame:
    """One nested row: dataset, metrics at the threshold, best threshold, per-class report, score statistics.

    ``df`` is read once, into a stored table of distinct scores and labels; everything else is weighed from that.
    """
    from telewarden.operators.ensemble import score_summary

    df = score_groups(df, label=label, score=score)
    names = {"label": label, "score": score, "weight": "n"}
    per_class = class_report(df, threshold, **names).agg(F.collect_list(F.struct("*")).alias("rows"))  # four rows
    return df.sparkSession.range(1).select(
        one_row(dataset_stats(df, label=label, weight="n")).alias("dataset_statistics"),
        one_row(binary_metrics(df, threshold, **names)).alias("metrics_at_threshold"),
        one_row(curve_areas(df, **names)).alias("areas"),
        one_row(best_threshold(df, "f1", **names)).alias("optimal_metrics"),
        per_class.scalar().alias("classification_report"),
        one_row(score_summary(df, threshold, score=score, weight="n")).alias("score_statistics"),
        F.lit(threshold).alias("threshold"),
    )
