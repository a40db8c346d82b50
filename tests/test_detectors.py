from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.operators import autoencoder, ensemble, graph, iforest
from telewarden.plans import models
from telewarden.sources import readers, writers
from telewarden.session import scratch_path


# ---- forest

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 8)) * 10 + 50
    x[:20] = rng.normal(size=(20, 8)) * 80 + 300
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>").repartition(6).cache()


@pytest.fixture(scope="module")
def forest(points):
    return iforest.fit_iforest(points, id_col="id", trees=60, contamination=0.05)


def test_forest_ranks_injected_outliers_first(points, forest):
    scored = forest.score(points).orderBy(F.col("s_if").desc())
    assert sum(r.id < 20 for r in scored.limit(25).collect()) >= 19


def test_forest_scores_and_labels(points, forest):
    for normalizer in ("fitted", "batch"):
        ends = forest.score(points, normalizer=normalizer).agg(F.min("s_if"), F.max("s_if"), F.count("s_if")).first()
        assert tuple(ends) == (0.0, 1.0, 1000)
    labels = {r.label: r["count"] for r in forest.predict(points).groupBy("label").count().collect()}
    assert set(labels) == {-1, 1} and labels[-1] == pytest.approx(50, abs=2)


def test_forest_does_not_depend_on_partitioning(points, forest):
    again = iforest.fit_iforest(points.repartition(2), id_col="id", trees=60)
    one = sorted(map(tuple, forest.nodes.collect()))
    assert one == sorted(map(tuple, again.nodes.collect())) and forest.offset == pytest.approx(again.offset)
    assert len({r[0] for r in one}) == 60


def test_forest_sizes_add_up(forest):
    nodes = {(r.tree_id, r.node_id): r for r in forest.nodes.collect()}
    for r in nodes.values():
        if r.feature >= 0:
            assert r["size"] == nodes[r.tree_id, r.left]["size"] + nodes[r.tree_id, r.right]["size"]
        assert r.depth <= 8
    assert all(nodes[t, 0]["size"] == 256 for t in range(60))


def test_forest_on_constant_rows_and_single_row(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(10)], "id int, features array<double>")
    fitted = iforest.fit_iforest(same, id_col="id", trees=5)
    assert {r.s_if for r in fitted.score(same).collect()} == {0.0}
    one = iforest.fit_iforest(same.limit(1), id_col="id", trees=5)
    assert one.score(same.limit(1)).first().s_if == 0.0
    with pytest.raises(ValueError, match="empty"):
        iforest.fit_iforest(same.where("id < 0"), id_col="id")


def test_expression_and_arrow_scoring_agree(spark, points, forest):
    rows = [tuple(r)[:7] for r in forest.nodes.where("tree_id < 2").collect()]
    part = iforest.IsolationForest(forest.nodes.where("tree_id < 2"), forest.width, forest.sample, 2)
    slots = [F.col("features")[i] for i in range(8)]
    both = points.select(part.raw_score("features").alias("a"), iforest.fixed_forest_score(rows, slots, forest.sample).alias("b"))
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


# ---- autoencoder

@pytest.fixture(scope="module")
def flats(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 12)) + rng.normal(size=(300, 12)) * 0.05 + 5
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, flat array<double>").repartition(4).cache()


def test_error_falls_with_the_code_size(flats):
    errors = []
    for k in (1, 2, 4, 12):
        model = autoencoder.fit_autoencoder(flats, "flat", k)
        errors.append(flats.select(model.error("flat").alias("e")).agg(F.avg("e")).first()[0])
    assert errors == sorted(errors, reverse=True) and errors[2] < 0.01 and errors[3] < 1e-20


def test_error_equals_that_of_the_decoded_sequence(flats):
    model = autoencoder.fit_autoencoder(flats, "flat", 3)
    decoded = flats.withColumn("hat", model.reconstruct("flat"))
    assert len(decoded.first().hat) == 12
    both = autoencoder.reconstruction_error(decoded, "flat", "hat").withColumn("direct", model.error("flat"))
    assert both.agg(F.max(F.abs(F.col("error") - F.col("direct")))).first()[0] < 1e-12


def test_autoencoder_scores(spark, flats):
    model = autoencoder.fit_autoencoder(flats, "flat", 3)
    for normalizer in ("fitted", "batch"):
        ends = model.score(flats, normalizer=normalizer).agg(F.min("s_lstm"), F.max("s_lstm"), F.count("s_lstm")).first()
        assert tuple(ends) == (0.0, 1.0, 300)
    odd = spark.createDataFrame([(1, [float(v * 50) for v in range(12)]), (2, None)], "id int, flat array<double>")
    assert [r.s_lstm for r in model.score(odd).orderBy("id").collect()] == [1.0, None]


# ---- graph

EDGES = [(0, 1, 0.5), (1, 2, 0.8), (2, 3, 0.3), (3, 4, 0.9), (4, 0, 0.6)]


def tables(spark, x, edges, graph="g"):
    nodes = spark.createDataFrame([(graph, i, r.tolist()) for i, r in enumerate(x)], "graph_id string, node_id long, features array<double>")
    return nodes, spark.createDataFrame([(graph, *e) for e in edges], "graph_id string, src long, dst long, traffic double")


def brute_force(x, edges, w, layers=3):
    h = x @ w
    for _ in range(layers):
        agg = np.zeros_like(h)
        for t in range(len(h)):
            sources = [e[0] for e in edges if e[1] == t]
            if sources:
                agg[t] = h[sources].mean(axis=0)
        h = np.maximum(0.5 * h + 0.5 * agg, 0)
    return h


@pytest.mark.parametrize("edges", [EDGES, [*EDGES, (0, 1, 0.1), (0, 1, 0.2), (5, 5, 1.0), (2, 1, 0.0)], []])
def test_embeddings_equal_brute_force(spark, edges):
    x = np.random.default_rng(0).normal(size=(10, 73))
    w = graph.projection_matrix(73, 12)
    nodes, table = tables(spark, x, edges)
    out = graph.forward(graph.project_features(nodes, w), table, 12)
    got = np.array([r.h for r in out.orderBy("node_id").collect()])
    assert got.shape == (10, 12) and np.allclose(got, brute_force(x, edges, w))
    scored = graph.graph_score(graph.graph_embedding(out, 12), 12).first()
    emb = brute_force(x, edges, w).mean(axis=0)
    assert np.allclose(scored.embedding, emb) and scored.s_gnn == pytest.approx(min(1.0, np.linalg.norm(emb - 0.5) / 10))


def test_many_sources_some_of_them_hot(spark):
    rng = np.random.default_rng(11)
    edges = [(0, int(d), 1.0) for d in rng.integers(0, 900, 900)] + [(int(s), int(d), 1.0) for s, d in rng.integers(0, 900, (1800, 2))]
    x = rng.normal(size=(900, 3))
    w = graph.projection_matrix(3, 4)
    nodes, table = tables(spark, x, edges)
    assert graph.count_edges(table, nodes).few_nodes
    counted = graph.count_edges(table, nodes, small_rows=100)
    assert [r.src for r in counted.hot.collect()] == [0]
    assert counted.table.where("src = 0").select("_tw_salt").distinct().count() > 30
    got = np.array([r.h for r in graph.forward(graph.project_features(nodes, w), table, 4, layers=2, small_rows=100).orderBy("node_id").collect()])
    assert np.allclose(got, brute_force(x, edges, w, 2))
    spread_out = [(s, d, t) for s, d, t in edges if s]
    _, even = tables(spark, x, spread_out)
    assert graph.count_edges(even, nodes, small_rows=100).hot is None
    got = np.array([r.h for r in graph.forward(graph.project_features(nodes, w), even, 4, layers=1, small_rows=100).orderBy("node_id").collect()])
    assert np.allclose(got, brute_force(x, spread_out, w, 1))


def test_a_vector_is_sent_once_per_block_of_targets(spark, monkeypatch):
    rng = np.random.default_rng(12)
    edges = [(0, d, 1.0) for d in range(300)] + [(int(s), int(d), 1.0) for s, d in rng.integers(0, 300, (2000, 2))]
    x = rng.normal(size=(300, 3))
    w = graph.projection_matrix(3, 4)
    nodes, table = tables(spark, x, edges)
    assert graph.count_edges(table, nodes).table.count() == len({s for s, *_ in edges})
    monkeypatch.setattr(graph, "BLOCK_NODES", 40)
    monkeypatch.setattr(graph, "STRIPE_NODES", 100)
    counted = graph.count_edges(table, nodes)
    assert counted.table.count() < 300 * 8 and counted.table.select("block", "stripe").distinct().count() == 8 * 3
    assert counted.table.where("src = 0").count() == 8
    got = np.array([r.h for r in graph.forward(graph.project_features(nodes, w), table, 4).orderBy("node_id").collect()])
    assert np.allclose(got, brute_force(x, edges, w))


def test_layers_and_embeddings_send_no_vector_to_python(spark):
    x = np.random.default_rng(3).normal(size=(40, 128))
    nodes, table = tables(spark, x, [(s, (s * 7 + 1) % 40, 1.0) for s in range(40)])
    h = nodes.select("graph_id", "node_id", F.col("features").alias("h"))
    for few in (100, 10):
        last = graph.neighbor_mean(graph.count_edges(table, h, small_rows=few), h, 128)
        for out in (last, graph.graph_embedding(h, 128)):
            assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    embedded = graph.graph_embedding(graph.forward(h, table, 128), 128).first().embedding
    assert np.allclose(embedded, brute_force(x, [(s, (s * 7 + 1) % 40) for s in range(40)], np.eye(128)).mean(axis=0))


@pytest.mark.parametrize(("layers", "few", "alpha"), [(1, 100, 0.5), (2, 5, 0.3), (3, 100, 0.5), (4, 5, 1.0)])
def test_embeddings_of_graphs_without_those_of_nodes(spark, layers, few, alpha):
    rng = np.random.default_rng(layers)
    x = rng.normal(size=(60, 3)) * 50 - 10
    rows = [("a" if k < 40 else "b", k, v.tolist()) for k, v in enumerate(x)]
    rows[3], rows[4], rows[45] = ("a", 3, None), ("a", 4, [1.0, None, 2.0]), ("b", 45, [float("nan"), 1.0, 2.0])
    rows.append(("only missing", 1, None))
    links = [("a", int(s), int(t)) for s, t in rng.integers(0, 38, (150, 2))] + [("b", int(s), int(t)) for s, t in rng.integers(40, 60, (60, 2))]
    links += links[:20] + [("a", 5, t) for t in range(38)] + [("a", 7, 7), ("a", 999, 1), ("a", 1, 999), ("b", 1, 41)]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id long, features array<double>")
    edges = spark.createDataFrame(links, "graph_id string, src long, dst long")
    w = graph.projection_matrix(3, 5) * 100

    def both(table, links):
        deep = graph.forward(graph.project_features(table, w), links, 5, layers=layers, alpha=alpha, small_rows=few)
        direct = graph.embed_graphs(table, links, w, layers=layers, alpha=alpha, small_rows=few)
        return [{r.graph_id: r.embedding for r in found.collect()} for found in (graph.graph_embedding(deep, 5), direct)]

    expected, got = both(nodes, edges)
    assert set(got) == set(expected) == {"a", "b"} and any(v > 0 for v in got["a"])
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    wild = nodes.withColumn("features", F.when(F.col("node_id") == 8, F.array(F.lit(float("inf")), F.lit(-1.0), F.lit(2.0))).otherwise(F.col("features")))
    expected, got = both(wild, edges)
    assert set(got) == set(expected)
    for k, v in expected.items():  # both take the path through all layers, whose sums come in any order
        assert got[k] == pytest.approx(v, rel=1e-9, nan_ok=True)
    assert both(nodes.limit(0), edges) == [{}, {}] and len(both(nodes, edges.limit(0))[1]) == 2


def test_scores_of_graphs_send_features_once_and_then_single_numbers(spark, monkeypatch):
    widths = []
    added = graph.sum_columns_by_key
    monkeypatch.setattr(graph, "sum_columns_by_key", lambda df, keys, h, width, **k: widths.append((len(keys), width)) or added(df, keys, h, width, **k))
    home = spark.range(30).select(F.lit("a").alias("graph_id"), F.col("id").alias("node_id"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    linked = spark.range(90).select(F.lit("a").alias("graph_id"), (F.col("id") % 30).alias("src"), ((F.col("id") * 7 + 3) % 30).alias("dst"))
    trained = models.Models(None, None, graph.projection_matrix(2, 8), 3)
    assert models.score_graphs(models.Graphs(home, linked, ["x", "y"]), trained).count() == 1
    assert widths == [(2, 2), (2, 1), (2, 1), (1, 8)]


def test_narrow_features_are_projected_in_the_jvm(spark):
    rows = [(0, [1.5, -2.0, 3.0]), (1, [0.25, 1e6, -7.0]), (2, [1.0, None, 2.0]), (3, [1.0, float("nan"), 2.0]), (4, None)]
    nodes = spark.createDataFrame([("g", *r) for r in rows], "graph_id string, node_id long, features array<double>")
    w = graph.projection_matrix(3)
    projected = graph.project_features(nodes, w)
    assert "Arrow" not in projected._jdf.queryExecution().executedPlan().toString()
    got = {r.node_id: r.h for r in projected.collect()}
    assert np.allclose([got[0], got[1]], np.array([r[1] for r in rows[:2]]) @ w, rtol=1e-12) and got[2] is got[3] is got[4] is None
    for wrong in ([1.0, 2.0], [1.0, 2.0, 3.0, 4.0]):
        with pytest.raises(Exception, match="3 entries expected"):
            graph.project_features(spark.createDataFrame([("g", 0, wrong)], nodes.schema), w).collect()
    assert "Arrow" in graph.project_features(nodes, graph.projection_matrix(73))._jdf.queryExecution().executedPlan().toString()


def test_default_width_and_single_node_score(spark):
    x = np.random.default_rng(1).normal(size=(3, 73))
    w = graph.projection_matrix(73)
    nodes, _ = tables(spark, x, [])
    got = [r.s for r in nodes.select("node_id", graph.single_node_score(F.col("features"), w).alias("s")).orderBy("node_id").collect()]
    for i, s in enumerate(got):
        h = brute_force(x[i : i + 1], [], w)[0]
        assert len(h) == 128 and s == pytest.approx(min(1.0, np.linalg.norm(h - 0.5) / 10))
    near = nodes.select(graph.single_node_score(F.col("features"), w, reference=[0.0] * 128).alias("s"))
    assert all(0 <= r.s < 0.1 for r in near.collect())


def test_edge_attributes(spark):
    _, table = tables(spark, np.zeros((1, 1)), EDGES)
    quiet = spark.createDataFrame([("q", 0, 1, 0.0)], table.schema)
    rows = graph.edge_attributes(table.union(quiet)).orderBy("graph_id", "src").collect()
    assert [r.edge_count for r in rows] == [5] * 5 + [1]
    assert [r.traffic_share for r in rows[:5]] == pytest.approx([t / 0.9 for *_, t in EDGES]) and rows[5].traffic_share is None
    assert graph.nodes_of(table).count() == 5


def test_dropout_is_seeded_and_scaled(spark):
    x = np.abs(np.random.default_rng(2).normal(size=(60, 4)))
    nodes, table = tables(spark, x, [])
    h = nodes.select("graph_id", "node_id", F.col("features").alias("h"))
    run = lambda seed: np.array([r.h for r in graph.forward(h, table, 4, layers=1, training=True, seed=seed).orderBy("node_id").collect()])
    a = run(1)
    assert np.array_equal(a, run(1)) and not np.array_equal(a, run(2))
    kept = a > 0
    assert 0.7 < kept.mean() < 0.9 and np.allclose(a[kept], (x / 2 / 0.8)[kept])


def test_sampled_graphs(spark, points):
    home = points.select(F.when(F.col("id") < 700, "a").otherwise("b").alias("graph_id"), F.col("id").alias("node_id"), F.col("features"))
    pairs = spark.range(3000).select(((F.col("id") * 37) % 1000).alias("src"), ((F.col("id") * 91 + 5) % 1000).alias("dst"), F.lit(1.0).alias("traffic"))
    linked = pairs.select(F.when(F.col("src") < 700, "a").otherwise("b").alias("graph_id"), "src", "dst", "traffic").where((F.col("src") < 700) == (F.col("dst") < 700))
    nodes, edges = graph.sample_graphs(home, linked, graphs=30)
    members = {}
    for r in nodes.collect():
        members.setdefault((r.graph_id, r.source_graph), set()).add(r.node_id)
        assert (r.node_id < 700) == (r.source_graph == "a") and len(r.features) > 0
    assert len(members) == 30 == len({s for s, _ in members}) and all(5 <= len(m) <= 24 for m in members.values()) and len(set(map(len, members.values()))) > 5
    assert {g for _, g in members} == {"a", "b"}
    expected = sorted((s, r.src, r.dst) for r in linked.collect() for (s, g), m in members.items() if g == r.graph_id and r.src in m and r.dst in m)
    assert sorted((r.graph_id, r.src, r.dst) for r in edges.collect()) == expected and expected
    assert sorted(map(tuple, graph.sample_graphs(home.repartition(7), linked, graphs=30)[0].select("graph_id", "node_id").collect())) == sorted(
        (s, k) for (s, _), m in members.items() for k in m
    )


def test_baseline_of_sampled_graphs(spark):
    home = spark.range(200).select(F.lit("a").alias("graph_id"), F.col("id").alias("node_id"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    linked = spark.range(800).select(F.lit("a").alias("graph_id"), (F.col("id") % 200).alias("src"), ((F.col("id") * 7 + 3) % 200).alias("dst"))
    matrix = graph.projection_matrix(2, 8)
    mean, std = graph.baseline(home, linked, matrix, ["x", "y"], graphs=20)
    found = np.array([r.embedding for r in graph.sampled_embeddings(home, linked, matrix, ["x", "y"], graphs=20).collect()])
    assert found.shape == (20, 8) and mean == pytest.approx(found.mean(axis=0)) and std == pytest.approx(found.std(axis=0))
    trained = models.Models(None, None, matrix, 3, mean, std)
    graphs = models.Graphs(home, linked, ["x", "y"])
    whole = models.score_graphs(graphs, trained).collect()
    assert len(whole) == 1 and 0 < whole[0].s_gnn < 0.01


def test_newest_complete_model_is_read(spark):
    root = scratch_path(spark, "versions")
    with pytest.raises(Exception):
        readers.read_model(spark, root)
    part = lambda n: {"part": spark.createDataFrame([(n,)], "n int")}
    writers.save_model(part(1), root)
    part(3)["part"].write.parquet(f"{root}/version-unfinished/part")
    assert readers.read_model(spark, root)["part"].first().n == 1
    writers.save_model(part(2), root)
    assert readers.read_model(spark, root)["part"].first().n == 2


# ---- ensemble

def scores(spark, *rows):
    return spark.createDataFrame(list(rows), "s_lstm double, s_if double, s_gnn double")


def test_weights_and_fusion_values(spark):
    assert sum(schemas.ENSEMBLE_WEIGHTS.values()) == pytest.approx(1.0, abs=1e-10) and schemas.VECTOR_WIDTH == 73
    got = [r.score for r in ensemble.fuse_scores(scores(spark, (0.3, 0.2, 0.4), (0.7, 0.6, 0.5), (0.9, 0.8, 0.85), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))).collect()]
    assert got[0] == pytest.approx(0.47 * 0.3 + 0.28 * 0.2 + 0.25 * 0.4, abs=1e-5)
    assert got[3:] == pytest.approx([1.0, 0.0]) and all(0 <= g <= 1 for g in got)


def test_other_weights_clip(spark):
    heavy = {"lstm": 2.0, "isolation_forest": 1.0, "gnn": 0.0}
    assert ensemble.fuse_scores(scores(spark, (0.9, 0.2, 0.1)), heavy).first().score == 1.0


def test_missing_model_scores(spark):
    df = scores(spark, (0.5, None, 0.1), (None, None, None), (0.5, 0.5, 0.5))
    assert [r.score for r in ensemble.fuse_scores(df).collect()][:2] == [None, None]
    rows = ensemble.fuse_scores(df, allow_missing=True).collect()
    assert rows[0].score == pytest.approx((0.47 * 0.5 + 0.25 * 0.1) / 0.72) and rows[0].missing_models == ["isolation_forest"]
    assert rows[1].score is None and len(rows[1].missing_models) == 3
    assert rows[2].score == pytest.approx(0.5) and rows[2].missing_models == []


def test_detection_is_inclusive_and_explained(spark):
    df = spark.createDataFrame([(0.85,), (0.8499999,), (None,)], "score double")
    assert [r.is_anomaly for r in ensemble.detect(df).collect()] == [True, False, None]
    row = ensemble.explain(scores(spark, (0.2, 0.9, 0.1)), threshold=0.3).first()
    assert row.top_model == "if" and row.if_contribution == pytest.approx(0.252) and row.is_anomaly
    assert row.lstm_contribution + row.if_contribution + row.gnn_contribution == pytest.approx(row.score)


def test_minmax_of_equal_and_missing_values(spark):
    same = spark.createDataFrame([(3.0,), (3.0,)], "e double")
    assert {r.s for r in ensemble.minmax_score(same, "e", "s").collect()} == {0.0}
    mixed = spark.createDataFrame([(1.0,), (None,), (5.0,)], "e double")
    assert [r.s for r in ensemble.minmax_score(mixed, "e", "s").collect()] == [0.0, None, 1.0]
    frozen = mixed.select(ensemble.fixed_minmax(F.col("e"), 2.0, 4.0, invert=True).alias("s"))
    assert [r.s for r in frozen.collect()] == [1.0, None, 0.0]


def test_models_survive_storage(spark, points):
    trained = models.train_all(points, id_col="id", trees=10, hidden=8)
    location = models.save_models(trained, spark, scratch_path(spark, "models"))
    half = spark.createDataFrame([(1,)], "length int")
    half.write.parquet(f"{location}/version-zzz/metadata")  # a writer that stopped half-way
    loaded = models.load_models(spark, location)
    a = models.score_vectors(points, trained).withColumnsRenamed({c: f"{c}_a" for c in ("s_lstm", "s_if", "s_gnn")})
    both = models.score_vectors(a, loaded)
    worst = both.agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_a"))) for c in ("s_lstm", "s_if", "s_gnn")]).first()
    assert max(worst) < 1e-12
    assert both.where("s_lstm between 0 and 1 and s_if between 0 and 1 and s_gnn between 0 and 1").count() == 1000


def test_the_stream_scores_its_graphs_once(spark, folder, monkeypatch):
    from telewarden.plans import detector_queries

    calls = []
    score = models.score_graphs
    monkeypatch.setattr(models, "score_graphs", lambda *a: calls.append(1) or score(*a))
    monkeypatch.setattr(detector_queries, "finish", lambda stream, session, label: session.createDataFrame([], stream.schema))
    assert detector_queries.stream_scoring(spark, folder).columns[:2] == ["timestamp", "node_name"]
    assert len(calls) == 1
