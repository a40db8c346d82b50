"""Missing values, one rule at every size, and small inputs that once went wrong."""

from __future__ import annotations

import math
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden import session
from telewarden.functions import skew
from telewarden.functions.vectors import multiply
from telewarden.operators import autoencoder, cleaning, ensemble, evaluation, graph, iforest, pca, policy, scaling, signatures, telemetry, windows
from telewarden.sources import readers

NAN = float("nan")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, NAN, 20.0), (3, None, 30.0), (4, 3.0, NAN)], "id int, a double, b double")
    assert tuple(cleaning.missing_count(df, ["a", "b"]).first()) == (3, 2, 1)
    for fill, a in (("mean", 2.0), ("median", 2.0)):
        got = {r.id: (r.a, r.b) for r in cleaning.handle_missing(df, ["a", "b"], fill).collect()}
        assert got == {1: (1.0, 10.0), 2: (a, 20.0), 3: (a, 30.0), 4: (3.0, 20.0)}
    forward = {r.id: r.a for r in cleaning.handle_missing(df.withColumn("k", F.lit(1)).withColumn("t", F.timestamp_seconds("id")), ["a"], "forward_fill", keys=["k"], order=["t"]).collect()}
    assert forward == {1: 1.0, 2: 1.0, 3: 1.0, 4: 3.0}
    assert [r.id for r in cleaning.handle_missing(df, ["a", "b"], "drop").collect()] == [1]
    for kind in ("standard", "minmax", "robust"):
        scaled = {r.id: r.b for r in scaling.fit_scale(df, ["a", "b"], kind).collect()}
        assert scaled[4] is None and all(math.isfinite(scaled[k]) for k in (1, 2, 3))
    for flagged in (cleaning.flag_iqr(df, ["a", "b"]), cleaning.flag_zscore(df, ["a", "b"], 2.9)):
        assert not any(r.is_outlier for r in flagged.collect())


@pytest.mark.parametrize("width", [1, 16, 128])
def test_incomplete_vectors_have_no_score(spark, width):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    matrix = np.arange(2 * width, dtype=float).reshape(2, width) / 100
    got = {r.id: r.p for r in df.select("id", multiply(F.col("v"), matrix).alias("p")).collect()}
    assert got[1] == pytest.approx(list(np.array([1.0, 2.0]) @ matrix)) and got[2] is got[3] is got[4] is None
    scores = {r.id: r.s for r in df.select("id", graph.single_node_score(F.col("v"), matrix).alias("s")).collect()}
    assert scores[1] is not None and scores[2] is scores[3] is scores[4] is None


@pytest.mark.parametrize("n", [60, 2000, 2001])
def test_samples_follow_one_rule(spark, monkeypatch, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    rows = skew.hash_subsamples(df, "k", 10, 50, 3, group_col="g").collect()
    groups = {g: {r.k for r in rows if r.g == g} for g in range(10)}
    assert all(len(v) == 50 for v in groups.values())
    if n > 1000:  # independent samples share rows, as many as chance has it
        assert 350 < len(set().union(*groups.values())) < 500
    monkeypatch.setattr(skew, "POOL_ROWS", 500)
    pooled = {r.k for r in skew.hash_subsamples(df, "k", 10, 50, 3, group_col="g").collect()}
    assert len(pooled) <= 600


def test_close_values_leave_no_side_empty():
    points = np.array([[1.0], [np.nextafter(1.0, 2.0)]] * 4)
    tree = iforest.grow_tree(points, np.random.default_rng(0), 5)
    assert all(n[5] > 0 for n in tree)


def test_labels_are_truncated(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("0,-0.5\n1,0.9\n2,1.0\n3,\n")
    assert [r.y_true for r in readers.read_labels(spark, str(tmp_path)).orderBy("row_id").collect()] == [0, 0, 1, None]


@pytest.mark.parametrize("tag", ["a:b", "c d", "k%", "p+q", "plain"])
def test_tags_come_back(spark, tmp_path, tag):
    where = str(tmp_path / "logs")
    spark.createDataFrame([(tag, "line")], "tag string, log string").write.partitionBy("tag").text(where)
    assert [tuple(r) for r in readers.read_logs(spark, where).collect()] == [(tag, "line")]


def test_only_two_names_are_secrets(spark):
    base = dict(action="get", namespace="x", status_code=401, response_time_ms=1, object_count=1)
    df = spark.createDataFrame([dict(base, resource=r) for r in ("secret", "secrets", "secretss", "s")])
    got = {r.resource: r.signature for r in signatures.tag_signatures(df).collect()}
    assert got == {"secret": "brute_force_auth", "secrets": "brute_force_auth", "secretss": "none", "s": "none"}


def test_time_is_never_the_wall_clock(spark):
    values = spark.createDataFrame([('{"node_name": "n"}',)], "value string")
    assert telemetry.parse_telemetry(values).first().ts is None
    stamped = values.withColumn("ingest_time", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    assert telemetry.parse_telemetry(stamped).first().ts.year == 2030


def test_wide_preprocessing_plans_fast(spark):
    cols = [f"c{i}" for i in range(73)]
    df = spark.range(200).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 10.0).alias(c) for i, c in enumerate(cols)])
    start = time.perf_counter()
    out = scaling.preprocess(df, cols).collect()
    assert len(out) == 200 and time.perf_counter() - start < 60


def test_panes_equal_direct_windows(spark):
    df = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(300))).alias("ts"), F.concat(F.lit("n"), F.pmod("id", F.lit(3)).cast("string")).alias("node_name"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("x"),
    )
    direct = df.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "node_name").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    want = {(r.node_name, r.t): (r.n, r.m, r.v) for r in direct.withColumn("t", windows.window_end_ms(F.col("w"))).collect()}
    got = {(r.node_name, r.timestamp): (r.window_size, *r.features) for r in windows.window_statistics(df, ["x"], slide="10 seconds").collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6, rel=1e-9) for k in want)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_local_scratch_on_a_cluster(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.scratch_root(fake)
    fake.sparkContext.getCheckpointDir = lambda: "shared:/folder"
    assert session.scratch_root(fake) == "shared:/folder"


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_quantiles_of_two_piles_stay_bounded(spark, monkeypatch, n):
    from telewarden.functions import quantiles

    held = []
    select = quantiles._select
    monkeypatch.setattr(quantiles, "_select", lambda df, brackets: held.extend(b.inside for b in brackets if not b.single()) or select(df, brackets))
    x = F.when(F.col("id") % 1000 == 0, F.rand(1) * 0.8 + 0.1).otherwise((F.col("id") % 2).cast("double"))
    df = spark.range(n).select(x.alias("x")).cache()
    values = np.array([r.x for r in df.collect()])
    probs = [0.1, 0.4995, 0.5, 0.5004, 0.9]
    got = quantiles.exact_quantiles(df, ["x"], probs, in_memory=100)["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)))
    assert all(k <= 100 for k in held)


def test_nan_scores_are_missing(spark):
    df = spark.createDataFrame([(1, NAN, 0.2, 0.4, 1.0), (2, None, 0.2, 0.4, 1.0), (3, 0.99, 0.98, 0.97, 1.0), (4, 0.1, 0.1, NAN, NAN)], "id int, s_lstm double, s_if double, s_gnn double, y_true double")
    fused = {r.id: r for r in ensemble.detect(ensemble.fuse_scores(df)).collect()}
    assert fused[1].score is fused[2].score is fused[4].score is None and fused[1].is_anomaly is None and fused[3].is_anomaly
    rest = {r.id: r for r in ensemble.fuse_scores(df, allow_missing=True).collect()}
    assert rest[1].score == rest[2].score == pytest.approx((0.28 * 0.2 + 0.25 * 0.4) / 0.53) and rest[1].missing_models == rest[2].missing_models == ["lstm"]
    raw = spark.createDataFrame([(1, NAN, 1), (2, None, 1), (3, 0.96, 1), (4, 0.1, 0)], "id int, score double, y_true int")
    levels = {r.id: (r.level, r.action, r.audit) for r in raw.select("id", policy.alert_level(F.col("score")).alias("level"), policy.recommend_action(F.col("score")).alias("action"), policy.audit_required(F.col("score")).alias("audit")).collect()}
    assert levels == {1: ("none", "ALLOW", False), 2: ("none", "ALLOW", False), 3: ("critical", "QUARANTINE", True), 4: ("none", "ALLOW", False)}
    assert tuple(evaluation.confusion(raw, 0.5).first()) == (1, 0, 0, 1)
    assert evaluation.curve_areas(raw).first().roc_auc == 1.0 and evaluation.roc_curve(raw).count() == 3
    assert evaluation.threshold_sweep(raw).where("threshold = 0").select("tp", "fp").first() == (1, 1)
    assert tuple(ensemble.score_summary(raw, 0.5).first())[:5] == (4, 1, 1, 0.1, 0.96)
    assert [r.s for r in ensemble.minmax_score(raw, "score", "s").orderBy("id").collect()] == [None, None, 1.0, 0.0]
    same = raw.where("id < 2 or id = 3")
    assert {r.id: r.s for r in ensemble.minmax_score(same, "score", "s").collect()} == {1: None, 3: 0.0}


def test_incomplete_rows_are_left_out_of_fits(spark):
    rng = np.random.default_rng(3)
    whole = [(k, rng.normal(size=3).tolist()) for k in range(300)]
    broken = [(1000, [NAN, 1.0, 2.0]), (1001, [1.0, None, 2.0]), (1002, None)]
    schema = "id long, v array<double>"
    clean, dirty = spark.createDataFrame(whole, schema), spark.createDataFrame(whole + broken, schema)
    a, b = pca.fit_pca(clean, "v", 2), pca.fit_pca(dirty, "v", 2)
    np.testing.assert_allclose(a.components, b.components, atol=1e-12)
    np.testing.assert_allclose(a.mean, b.mean, atol=1e-12)
    trees = [iforest.fit_iforest(d, id_col="id", features="v", trees=5) for d in (clean, dirty)]
    assert sorted(map(tuple, trees[0].nodes.collect())) == sorted(map(tuple, trees[1].nodes.collect())) and trees[0].offset == trees[1].offset
    coders = [autoencoder.fit_autoencoder(d, "v", 1) for d in (clean, dirty)]
    assert coders[0].low == pytest.approx(coders[1].low)


def test_nan_counts_in_no_window_statistic(spark):
    rows = [(1, 1.0), (2, NAN), (3, 3.0), (4, None)]
    df = spark.createDataFrame(rows, "s int, x double").select(F.lit("n").alias("node_name"), F.timestamp_seconds("s").alias("ts"), "x")
    for slide in (None, "30 seconds"):
        got = windows.window_statistics(df, ["x"], slide=slide).orderBy("timestamp").first()
        assert (got.window_size, got.features) == (4, [2.0, 1.0])
