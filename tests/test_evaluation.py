from __future__ import annotations

import json

import numpy as np
import pytest

from telewarden.operators import evaluation
from telewarden.session import scratch_path
from telewarden.sources.writers import write_report


def table(spark, truth, scores):
    return spark.createDataFrame([(int(t), None if s is None else float(s)) for t, s in zip(truth, scores)], "y_true int, score double")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(6)
    truth = (rng.random(600) < 0.3).astype(int)
    scores = np.clip(np.round(rng.normal(0.4 + 0.2 * truth, 0.2), 2), 0, 1)  # many ties, and scores on thresholds
    return truth, scores


def pair_auc(truth, scores):
    pos, neg = scores[truth == 1], scores[truth == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def pr_points(truth, scores):
    out = [(0.0, 1.0)]
    for t in sorted(set(scores), reverse=True):
        said = scores >= t
        tp = (said & (truth == 1)).sum()
        out.append((tp / truth.sum(), tp / said.sum()))
    return np.array(out)


@pytest.mark.parametrize("rows_per_range", [10, 1_000_000])
def test_areas_and_curves(spark, sample, rows_per_range):
    truth, scores = sample
    df = table(spark, truth, scores)
    areas = evaluation.curve_areas(df, rows_per_range=rows_per_range).first()
    points = pr_points(truth, scores)
    assert areas.roc_auc == pytest.approx(pair_auc(truth, scores))
    assert areas.pr_auc == pytest.approx(np.trapezoid(points[:, 1], points[:, 0]))
    roc = evaluation.roc_curve(df, rows_per_range=rows_per_range).orderBy("threshold", ascending=False).collect()
    assert len(roc) == len(set(scores)) + 1 and (roc[0].fpr, roc[0].tpr) == (0.0, 0.0) and (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)
    for r in roc[1:]:
        assert r.tpr == pytest.approx((scores[truth == 1] >= r.threshold).mean()) and r.fpr == pytest.approx((scores[truth == 0] >= r.threshold).mean())
    pr = evaluation.pr_curve(df, rows_per_range=rows_per_range).collect()
    assert sorted((round(r.recall, 9), round(r.precision, 9)) for r in pr) == sorted((round(a, 9), round(b, 9)) for a, b in points)


@pytest.mark.parametrize("truth", [[1, 1, 1], [0, 0, 0]])
def test_one_class_only(spark, truth):
    df = table(spark, truth, [0.1, 0.9, 0.5])
    areas = evaluation.curve_areas(df).first()
    assert areas.roc_auc == 0.0
    assert areas.pr_auc == (pytest.approx(1.0) if truth[0] else 0.0)
    m = evaluation.binary_metrics(df, 0.5).first()
    assert m.precision == (1.0 if truth[0] else 0.0) and m.specificity == (0.0 if truth[0] else pytest.approx(1 / 3))


def test_empty_table(spark):
    df = table(spark, [], [])
    assert evaluation.curve_areas(df).first().roc_auc == 0.0
    assert evaluation.binary_metrics(df).first().accuracy == 0.0
    assert evaluation.best_threshold(df).first().threshold == 0.5


def test_metrics(spark):
    df = table(spark, [1, 1, 1, 0, 0, 0, 0], [0.85, 0.9, 0.2, 0.85, 0.1, 0.84, 0.3])
    m = evaluation.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 3)
    assert (m.accuracy, m.precision, m.recall, m.specificity, m.f1_score) == pytest.approx((5 / 7, 2 / 3, 2 / 3, 3 / 4, 2 / 3))


def test_sweep(spark, sample):
    truth, scores = sample
    rows = evaluation.threshold_sweep(table(spark, truth, scores)).orderBy("threshold").collect()
    assert [r.threshold for r in rows] == [i * 0.01 for i in range(101)]
    for r in rows:
        said = scores >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((said & (truth == 1)).sum(), (said & (truth == 0)).sum(), (~said & (truth == 1)).sum(), (~said & (truth == 0)).sum())


@pytest.mark.parametrize("metric", ["f1", "precision", "recall", "roc_auc", "unknown"])
def test_best_threshold(spark, sample, metric):
    truth, scores = sample
    best, best_value = 0.5, 0.0
    for i in range(101):
        said = scores >= i * 0.01
        tp, fp, fn = (said & (truth == 1)).sum(), (said & (truth == 0)).sum(), (~said & (truth == 1)).sum()
        value = {"precision": tp / max(tp + fp, 1), "recall": tp / (tp + fn), "roc_auc": pair_auc(truth, scores)}.get(metric, 2 * tp / (2 * tp + fp + fn))
        if value > best_value:
            best, best_value = i * 0.01, value
    row = evaluation.best_threshold(table(spark, truth, scores), metric).first()
    assert row.threshold == best and row.optimized == pytest.approx(best_value)


def test_nothing_to_optimize(spark):
    row = evaluation.best_threshold(table(spark, [0, 0], [0.1, 0.7])).first()
    assert row.threshold == 0.5 and row.fp == 1


def test_scores_outside_the_grid(spark):
    rows = {round(r.threshold, 2): r for r in evaluation.threshold_sweep(table(spark, [1, 1, 0, 1], [-0.5, 1.5, 1.0, None])).collect()}
    assert (rows[0.0].tp, rows[0.0].fn, rows[1.0].tp, rows[1.0].fp) == (1, 1, 1, 1)


def test_class_report(spark):
    rows = {r["class"]: r for r in evaluation.class_report(table(spark, [1, 1, 0, 0, 0], [0.9, 0.1, 0.9, 0.2, 0.3])).collect()}
    assert rows["Normal"].support == 3 and rows["Normal"].precision == pytest.approx(2 / 3) and rows["Normal"].recall == pytest.approx(2 / 3)
    assert rows["Anomaly"].f1_score == pytest.approx(0.5)
    assert rows["macro avg"].recall == pytest.approx((2 / 3 + 0.5) / 2)
    assert rows["weighted avg"].recall == pytest.approx(0.6) and rows["weighted avg"].support == 5


def test_zip_mismatches(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.6)], "row_id long, score double")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0)], "row_id long, y_true int")
    assert [tuple(r) for r in evaluation.zip_labels(scores, labels).collect()] == [(2, 0.6, 1)]
    assert tuple(evaluation.zip_mismatches(scores, labels).first()) == (1, 2)


def test_report_is_written_as_json(spark, sample):
    truth, scores = sample
    location = write_report(evaluation.evaluation_report(table(spark, truth, scores)), scratch_path(spark, "report"))
    report = json.loads(spark.read.text(location).first().value)
    assert report["dataset_statistics"]["total_samples"] == 600
    assert {r["class"] for r in report["classification_report"]} == {"Normal", "Anomaly", "macro avg", "weighted avg"}
    assert report["score_statistics"]["std"] == pytest.approx(scores.std())
    assert report["areas"]["roc_auc"] == pytest.approx(pair_auc(truth, scores))
