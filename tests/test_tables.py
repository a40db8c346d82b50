from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden.operators import cleaning, pca, scaling, sequences

NAN = float("nan")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1.0, 20.0, 0.0] + [0.0, 50.0, 7.0]
    x[:4, 0] = 40.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").repartition(4).cache()
    return df, x


def values(df, cols, order="id"):
    return np.array([[r[c] for c in cols] for r in df.orderBy(order).collect()], dtype=float)


COLS = ["a", "b", "c"]


def test_nan_becomes_missing(spark):
    df = cleaning.nan_to_null(spark.createDataFrame([(1.0, NAN), (NAN, 2.0)], "a double, b double"), ["a", "b"])
    assert sorted(cleaning.missing_count(df, ["a", "b"]).first()) == [1, 1, 2]


@pytest.mark.parametrize(("strategy", "expected"), [("mean", 3.0), ("median", 2.0)])
def test_fill(spark, strategy, expected):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (3, 6.0, None), (4, None, None)], "id int, a double, b double")
    rows = cleaning.handle_missing(df, ["a", "b"], strategy).orderBy("id").collect()
    assert rows[3].a == expected and all(r.b is None for r in rows)


def test_forward_fill_keeps_leading_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("x", t, 1, None), ("x", t, 2, 5.0), ("x", t + dt.timedelta(days=9), 3, None), ("y", t, 4, None), ("y", t, 5, None)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, id int, v double")
    out = cleaning.handle_missing(df, ["v"], "forward_fill", keys=["node"], order=["ts", "id"]).orderBy("id").collect()
    assert [r.v for r in out] == [None, 5.0, 5.0, None, None]


def test_iqr_flags_strictly_outside(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 3, 4, 7, 8])], "id int, a double")
    x = np.array([0, 1, 2, 3, 4, 7, 8.0])
    q1, q3 = np.percentile(x, [25, 75])
    expected = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    assert [r.is_outlier for r in cleaning.flag_iqr(df, ["a"]).orderBy("id").collect()] == expected.tolist()
    bounds = spark.createDataFrame([((1.0, 7.0),)], "a struct<lower: double, upper: double>")
    held = cleaning.flag_iqr(df, ["a"], bounds).orderBy("id").collect()
    assert [r.is_outlier for r in held] == [True, False, False, False, False, False, True]


@pytest.mark.parametrize("scope", ["global", "column"])
def test_zscore(matrix, scope):
    df, x = matrix
    mean, std = (x.mean(), x.std()) if scope == "global" else (x.mean(axis=0), x.std(axis=0))
    with np.errstate(invalid="ignore", divide="ignore"):
        expected = (np.abs((x - mean) / std) > 2.0).any(axis=1)
    flagged = cleaning.flag_zscore(df, COLS, 2.0, scope=scope)
    assert [r.is_outlier for r in flagged.orderBy("id").collect()] == expected.tolist()
    summary = cleaning.outlier_summary(flagged).first()
    assert (summary.n, summary.outliers) == (500, expected.sum()) and summary.percent == pytest.approx(100 * expected.mean())
    assert cleaning.remove_outliers(flagged).count() == (~expected).sum()


def test_zscore_of_constants_flags_nothing(spark):
    df = spark.createDataFrame([(5.0, 5.0)] * 4, "a double, b double")
    assert cleaning.flag_zscore(df, ["a", "b"]).where("is_outlier").count() == 0


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust", "anything"])
def test_scalers_equal_numpy(matrix, kind):
    df, x = matrix
    if kind == "standard":
        centre, scale = x.mean(axis=0), x.std(axis=0)
    elif kind == "minmax":
        centre, scale = x.min(axis=0), np.ptp(x, axis=0)
    else:
        centre = np.median(x, axis=0)
        scale = np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    got = values(scaling.fit_scale(df, COLS, kind), COLS)
    assert np.allclose(got, (x - centre) / scale)
    assert np.allclose(got[:, 2], 0.0)


def test_fitted_parameters_are_reused(matrix):
    df, x = matrix
    params = scaling.fit_scaler(df.where("id < 100"), COLS)
    got = values(scaling.scale(df, ["a"], params), ["a"])[:, 0]
    assert np.allclose(got, (x[:, 0] - x[:100, 0].mean()) / x[:100, 0].std())


def test_preprocess_with_components(matrix):
    df, _ = matrix
    out = scaling.preprocess(df, COLS, components=2)
    assert out.count() < 500 and len(out.first().features) == 2
    assert scaling.preprocess(df, COLS, outliers=False, normalize=False).count() == 500


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) * [9, 4, 2, 1, 0.5, 0.1] + 3.0
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(5).cache(), x


def test_components_equal_eigenvectors(cloud, spark):
    df, x = cloud
    model = pca.fit_pca(df, "v", 6)
    centred = x - x.mean(axis=0)
    eig, vec = np.linalg.eigh(centred.T @ centred / (len(x) - 1))
    assert np.allclose(model.components @ model.components.T, np.eye(6), atol=1e-9)
    assert np.allclose(model.ratios, (eig / eig.sum())[::-1])
    assert np.all(np.diff(model.ratios) <= 1e-12)
    assert np.allclose(np.abs(model.components), np.abs(vec.T[::-1]), atol=1e-6)
    assert np.all(model.components[np.arange(6), np.abs(model.components).argmax(axis=1)] > 0)
    got = np.array([r.z for r in model.project(df, "v", "z").orderBy("id").collect()])
    assert np.allclose(got, centred @ model.components.T)
    again = pca.PcaModel.from_table(model.to_table(spark))
    assert np.allclose(again.components, model.components) and np.allclose(again.mean, model.mean)


@pytest.mark.parametrize("ratio", [0.5, 0.9, 0.999])
def test_component_count_follows_ratio(cloud, ratio):
    df, _ = cloud
    every = pca.fit_pca(df, "v", 6).ratios
    kept = pca.fit_pca(df, "v", ratio).ratios
    assert kept.sum() > ratio and every[: len(kept) - 1].sum() <= ratio


def series(spark, n):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("n", t + dt.timedelta(seconds=i), i, float(i)) for i in range(n)], "node string, ts timestamp, id int, x double")


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (3, 0), (4, 1), (10, 7)])
def test_sequence_count(spark, n, expected):
    built = sequences.create_sequences(series(spark, n), F.col("x"), keys=["node"], order=["ts", "id"], length=4)
    rows = built.orderBy("id").collect()
    assert len(rows) == expected
    assert all(r.sequence == [float(r.id - 3 + k) for k in range(4)] for r in rows)


def test_sequence_shapes(spark):
    df = series(spark, 5).withColumn("f", F.array("x", F.col("x") * 2))
    built = sequences.create_sequences(df, F.col("f"), keys=["node"], order=["ts", "id"], length=3, chunk_rows=3)
    row = built.withColumn("flat", sequences.flatten_sequence(F.col("sequence"))).withColumn("last", sequences.last_timestep(F.col("sequence"))).orderBy("id").first()
    assert row.flat == [0.0, 0.0, 1.0, 2.0, 2.0, 4.0] and row["last"] == [2.0, 4.0]
    tiled = df.select(sequences.tile_sequence(F.col("f"), 60).alias("t")).first().t
    assert len(tiled) == 60 and tiled[0] == tiled[-1]


@pytest.mark.parametrize(("n", "in_memory"), [(1, 9), (2, 9), (9, 2), (100, 3), (100, 1_000_000)])
def test_split_takes_the_earliest_rows(spark, n, in_memory):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=(i * 37 % n) // 3)) for i in range(n)]
    marked = sequences.split_by_time(spark.createDataFrame(rows, "id int, ts timestamp"), time_col="ts", id_col="id", in_memory=in_memory)
    train = [r.id for r in marked.where("split = 'train'").collect()]
    ordered = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(train) == sorted(ordered[: int(n * 0.8)])


def test_hash_split_is_stable(spark):
    df = spark.range(5000)
    first = sequences.split_by_hash(df, id_col="id").where("split = 'train'")
    again = sequences.split_by_hash(df.repartition(3), id_col="id").where("split = 'train'")
    assert first.count() == again.count() == first.join(again, "id").count()
    assert 0.77 < first.count() / 5000 < 0.83
