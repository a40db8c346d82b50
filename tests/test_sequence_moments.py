"""Sequence statistics from rows against the stored sequences, and sums of vectors by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telewarden.functions import vector_sums
from telewarden.operators import autoencoder, sequence_moments, sequences
from telewarden.operators.pca import PcaModel
from telewarden.session import small_table

LENGTH, WIDTH = 6, 3


def rows_of(seed, nodes=4, most=90):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for node in [None, *[f"n{i}" for i in range(nodes)]]:
        for t in range(int(rng.integers(2, most))):
            vector = (np.array([1000.0, 0.0, 5.0]) + rng.normal(size=WIDTH) * [1.0, 0.1, 3.0]).tolist()
            if rng.random() < 0.03:
                vector[int(rng.integers(WIDTH))] = float("nan")
            if rng.random() < 0.02:
                vector[int(rng.integers(WIDTH))] = None
            rows.append((k, node, t, None if rng.random() < 0.02 else vector, bool(rng.random() < 0.8)))
            k += 1
    return rows


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, node string, t long, x array<double>, train boolean")
    return df.withColumn("ts", F.timestamp_seconds("t")).repartition(5)


def built(rows):
    """id -> (flat sequence or None, mark) of every row that ends one."""
    out = {}
    for node in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == node), key=lambda r: r[2])
        for i in range(LENGTH - 1, len(own)):
            steps = [r[3] for r in own[i - LENGTH + 1 : i + 1]]
            bad = any(s is None or any(v is None or v != v for v in s) for s in steps)
            out[own[i][0]] = (None if bad else np.array(steps).ravel(), own[i][4])
    return out


@pytest.mark.parametrize("chunk_rows", [7, 100_000])
def test_moments_equal_stored_sequences(spark, chunk_rows):
    rows = rows_of(5)
    stored = sequence_moments.stretches(table_of(spark, rows), F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH, keep=["id"], marked=F.col("train"), chunk_rows=chunk_rows)
    flat = np.array([s for s, mark in built(rows).values() if mark and s is not None])
    count, mean, covariance = sequence_moments.sequence_moments(stored, WIDTH, LENGTH)
    assert count == len(flat)
    np.testing.assert_allclose(mean, flat.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(covariance, np.cov(flat.T), atol=1e-9)


def test_rows_fit_and_score_as_sequences_do(spark):
    rows = rows_of(8)
    df = table_of(spark, rows)
    stored = sequence_moments.stretches(df, F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH, keep=["id"], chunk_rows=20)
    model = autoencoder.fit_autoencoder_on_rows(stored, LENGTH, 4)
    old = sequences.create_sequences(df, F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH)
    flat = old.withColumn("flat", F.when(F.size("sequence") == LENGTH, sequences.flatten_sequence(F.col("sequence")))).where(F.size("flat") == LENGTH * WIDTH)
    before = autoencoder.fit_autoencoder(flat, "flat", 4)
    np.testing.assert_allclose(model.pca.components, before.pca.components, atol=1e-8)
    np.testing.assert_allclose(model.pca.ratios, before.pca.ratios, atol=1e-9)
    assert (model.low, model.high) == pytest.approx((before.low, before.high))
    got = {r["id"]: r["error"] for r in model.row_errors(stored, LENGTH).collect()}
    expected = built(rows)
    assert set(got) == set(expected)
    for k, (steps, _) in expected.items():
        assert got[k] is None if steps is None else got[k] == pytest.approx(model.errors(steps[None])[0])
    scores = [r["s_lstm"] for r in model.score_rows(stored, LENGTH).collect() if r["s_lstm"] is not None]
    assert min(scores) == 0 and max(scores) == 1


def test_nothing_to_fit(spark):
    short = table_of(spark, [(1, "a", 1, [1.0, 2.0, 3.0], True)])
    stored = sequence_moments.stretches(short, F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH, keep=["id"])
    with pytest.raises(ValueError):
        autoencoder.fit_autoencoder_on_rows(stored, LENGTH)
    assert sequence_moments.map_sequences(stored, WIDTH, LENGTH, lambda x: x.sum(axis=1), "e").count() == 0


@pytest.mark.parametrize("held", [4, 1 << 23])
def test_sums_by_key(spark, monkeypatch, held):
    monkeypatch.setattr(vector_sums, "HELD_NUMBERS", held)
    rng = np.random.default_rng(1)
    rows = [(None if k == 3 else int(k), f"g{k % 2}", rng.normal(size=2).tolist(), int(rng.integers(1, 4))) for k in rng.integers(0, 9, 500)]
    rows += [(1, "g1", None, 1), (1, "g1", [float("nan"), 1.0], 1), (1, "g1", [None, 1.0], 1), (77, "g0", None, 2)]
    df = spark.createDataFrame(rows, "k int, g string, v array<double>, w int").repartition(6)
    got = {(r["k"], r["g"]): (r["n"], r["total"]) for r in vector_sums.sum_by_key(df, ["k", "g"], "v", 2, weight="w").collect()}
    expected = {}
    for k, g, v, w in rows:
        if v is not None and all(x is not None and x == x for x in v):
            n, total = expected.get((k, g), (0, np.zeros(2)))
            expected[k, g] = (n + w, total + w * np.array(v))
    assert set(got) == set(expected)
    for key, (n, total) in expected.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(total)


def test_vector_sums_over_many_batches_without_weights(spark, monkeypatch):
    monkeypatch.setattr(vector_sums, "HELD_NUMBERS", 1000)
    rows = spark.range(0, 25_000, 1, 2).select((F.col("id") * 7919 % 12_007).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = {r["k"]: (r["n"], r["total"]) for r in vector_sums.sum_by_key(rows, ["k"], "v", 2).collect()}
    expected = {}
    for i in range(25_000):
        expected.setdefault(i * 7919 % 12_007, []).append(i)
    assert got == {k: (len(v), [float(sum(v)), float(len(v))]) for k, v in expected.items()}


def test_column_sums_equal_matrix_sums_and_stay_in_the_jvm(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k == 3 else int(k), f"g{k % 2}", rng.normal(size=2).tolist(), int(rng.integers(1, 4))) for k in rng.integers(0, 9, 300)]
    rows += [(1, "g1", None, 1), (1, "g1", [float("nan"), 1.0], 1), (1, "g1", [None, 1.0], 1), (77, "g0", None, 2)]
    df = spark.createDataFrame(rows, "k int, g string, v array<double>, w int").repartition(6)
    for weight in ("w", None):
        got, expected = (
            {(r["k"], r["g"]): (r["n"], r["total"]) for r in add(df, ["k", "g"], "v", 2, weight=weight).collect()}
            for add in (vector_sums.sum_columns_by_key, vector_sums.sum_by_key)
        )
        assert set(got) == set(expected) and (77, "g0") not in got
        for key, (n, total) in expected.items():
            assert got[key][0] == n and got[key][1] == pytest.approx(total)


def test_moments_are_not_held_again_before_the_shuffle(spark, monkeypatch):
    rows = rows_of(3)
    stored = sequence_moments.stretches(table_of(spark, rows), F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH, keep=["id"])
    seen = []

    def spied(*args, **options):
        seen.append(vector_sums.sum_by_key(*args, **options))
        return seen[-1]

    monkeypatch.setattr(sequence_moments, "sum_by_key", spied)
    count, _, _ = sequence_moments.sequence_moments(stored, WIDTH, LENGTH)
    assert count == sum(s is not None for s, _ in built(rows).values())
    plan = seen[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2  # moments of each task, and their sum
    with pytest.raises(ValueError):
        vector_sums.sum_by_key(spark.range(1).select("id", F.array(F.lit(1.0)).alias("v"), F.lit(2).alias("w")), ["id"], "v", 1, weight="w", combine=False)


@pytest.mark.parametrize("length", [1, 3, 6])
def test_scoring_holds_pieces_of_stretches(length):
    # One group of 1 000 rows, one whose positions have a gap, one shorter than a sequence.
    rows = [(1, p) for p in range(1000)] + [(2, p) for p in range(40) if p != 17] + [(3, 0), (3, 1)]
    table = pa.table({"_tw_group": [g for g, _ in rows], "pos": [p for _, p in rows]})
    batches = table.to_batches(max_chunksize=7)
    ends = []
    for piece in sequence_moments._pieces(sequence_moments._parts(iter(batches)), length, 16):
        assert piece.num_rows <= 16 + 7 + 2 * length
        ends += [(r["_tw_group"], r["pos"]) for r in piece.slice(length - 1).to_pylist()]
    whole = [r for t in sequence_moments._grouped(iter(batches)) for r in t.slice(length - 1).to_pylist()]
    assert ends == [(r["_tw_group"], r["pos"]) for r in whole] and len(ends) == len(set(ends)) > 1000


def test_pieces_give_the_same_errors(spark, monkeypatch):
    stored = sequence_moments.stretches(table_of(spark, rows_of(5)), F.col("x"), keys=["node"], order=["ts", "id"], length=LENGTH, keep=["id"])
    whole = sequence_moments.map_sequences(stored, WIDTH, LENGTH, lambda x: x.sum(axis=1), "e").collect()
    monkeypatch.setattr(sequence_moments, "PIECE_ROWS", 5)
    pieces = sequence_moments.map_sequences(stored, WIDTH, LENGTH, lambda x: x.sum(axis=1), "e").collect()
    assert sorted(map(str, whole)) == sorted(map(str, pieces)) and any(r["e"] is not None for r in whole)


def test_small_tables_start_no_python_worker(spark):
    model = autoencoder.SequenceAutoencoder(PcaModel(np.zeros(2), np.eye(2), np.ones(2)), None, 1.5)
    for table in model.to_tables(spark).values():
        assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()
    back = autoencoder.SequenceAutoencoder.from_tables(**dict(zip(("components", "bounds"), model.to_tables(spark).values(), strict=True)))
    assert (back.low, back.high) == (None, 1.5) and (back.pca.components == np.eye(2)).all() and (back.pca.ratios == 1).all()
    empty = small_table(spark, [], "dimension int, mean double")
    assert empty.count() == 0 and empty.dtypes == [("dimension", "int"), ("mean", "double")]
