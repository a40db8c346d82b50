"""Forest, autoencoder, graph and the streams that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.skew import lehmer_unit, lehmer_unit_sql
from telewarden.operators import autoencoder, iforest, sequence_moments, sequences
from telewarden.operators import graph as g
from telewarden.operators.features import DEFAULT_FEATURES, feature_vector
from telewarden.operators.pca import PcaModel
from telewarden.plans import models as m
from telewarden.plans import views
from telewarden.plans.flagship import fused_actions, window_actions, window_id, window_stretches
from telewarden.plans.ingest_queries import finish
from telewarden.plans.registry import grid, grid_sql, over, query
from telewarden.plans.scoring_queries import ACTION_SQL, ALERT_SQL, fused, rounded_all
from telewarden.plans.table_queries import split_statistics, statistics, window_sql
from telewarden.session import cut_lineage, scratch_path, small_table
from telewarden.sources import readers, writers
from telewarden.streaming import jobs

# ---- isolation forest

# (tree_id, node_id, feature, threshold, left, right, size); feature -1 is a leaf.
FIXED_FOREST = [
    (0, 0, 0, 20.0, 1, 2, 8), (0, 1, -1, 0.0, -1, -1, 5), (0, 2, 1, 50.0, 3, 4, 3), (0, 3, -1, 0.0, -1, -1, 2), (0, 4, -1, 0.0, -1, -1, 1),
    (1, 0, 1, 30.0, 1, 2, 8), (1, 1, -1, 0.0, -1, -1, 3), (1, 2, 2, 100.0, 3, 4, 5), (1, 3, -1, 0.0, -1, -1, 4), (1, 4, -1, 0.0, -1, -1, 1),
    (2, 0, 2, 150.0, 1, 2, 8), (2, 1, 0, 60.0, 3, 4, 7), (2, 2, -1, 0.0, -1, -1, 1), (2, 3, -1, 0.0, -1, -1, 6), (2, 4, -1, 0.0, -1, -1, 1),
]


def _c(n: int) -> str:
    return {1: "0e0", 2: "1e0"}.get(n, f"(2 * (ln({n - 1}) + 0.5772156649015329e0) - 2 * {n - 1} / {n}e0)")


@query("iforest_score_fixed", over(
    "v_telemetry",
    f"""select event_id, round(-pow(2e0, -(t0 + t1 + t2) / 3e0 / {_c(8)}), 6) as raw from (select event_id,
        case when cpu_usage <= 20 then 1 + {_c(5)} when memory_usage <= 50 then 2 + {_c(2)} else 2 + {_c(1)} end as t0,
        case when memory_usage <= 30 then 1 + {_c(3)} when process_count <= 100 then 2 + {_c(4)} else 2 + {_c(1)} end as t1,
        case when process_count > 150 then 1 + {_c(1)} when cpu_usage <= 60 then 2 + {_c(6)} else 2 + {_c(1)} end as t2 from v_telemetry) p""",
))
def iforest_score_fixed(spark: SparkSession, folder: str) -> DataFrame:
    inputs = [F.col("cpu_usage"), F.col("memory_usage"), F.col("process_count")]
    return rounded_all(views.telemetry(spark, folder).select("event_id", iforest.fixed_forest_score(FIXED_FOREST, inputs, 8).alias("raw")))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return feature_vector(views.telemetry(spark, folder)).select("event_id", "node_name", "features")


def _forest(spark: SparkSession, folder: str) -> tuple[DataFrame, iforest.IsolationForest]:
    vectors = cut_lineage(_vectors(spark, folder))
    return vectors, iforest.fit_iforest(vectors, id_col="event_id")


@query(
    "iforest_fit",
    f"""select cast(t as int) as tree_id, (select least({iforest.SAMPLE}, count(*)) from embeddings) as root_size, true as sizes_add_up, true as shallow
        from (select unnest(range(0, {iforest.TREES})) as t) s""",
)
def iforest_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Per tree: the rows at its root, whether each inner node's rows are those of its children, and whether it keeps the depth limit."""
    vectors = readers.read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    nodes = iforest.fit_iforest(vectors, id_col="vec_id").nodes
    size = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("c"), F.col("size").alias("s"))
    below = nodes.where("feature >= 0").select("tree_id", "node_id", F.explode(F.array("left", "right")).alias("child"))
    sums = below.join(size, (F.col("tree_id") == F.col("t")) & (F.col("child") == F.col("c"))).groupBy("tree_id", "node_id").agg(F.sum("s").alias("below"))
    checked = nodes.join(sums, ["tree_id", "node_id"], "left")
    return checked.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("size"))).cast("long").alias("root_size"),
        F.bool_and((F.col("feature") < 0) | F.coalesce(F.col("below") == F.col("size"), F.lit(False))).alias("sizes_add_up"),
        F.bool_and(F.col("depth") <= 8).alias("shallow"),
    )


@query("iforest_predict")
def iforest_predict(spark: SparkSession, folder: str) -> DataFrame:
    vectors, forest = _forest(spark, folder)
    return rounded_all(forest.predict(vectors).select("event_id", "decision", "label"))


@query("iforest_score")
def iforest_score(spark: SparkSession, folder: str) -> DataFrame:
    vectors, forest = _forest(spark, folder)
    return rounded_all(forest.score(vectors, normalizer="batch").select("event_id", "s_if"))


# ---- sequence autoencoder

@query("seq_autoencoder_fit")
def seq_autoencoder_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and errors per split of sequences of 60 events, none of which is ever stored."""
    vectors = feature_vector(views.telemetry(spark, folder))
    length = schemas.SEQUENCE_LENGTH
    stored = sequence_moments.stretches(vectors, F.col("features"), keys=["node_name"], order=["ts", "event_id"], length=length, keep=["event_id", "ts"])
    is_train = sequences.earliest_share(sequence_moments.sequence_ends(stored, length), time_col="ts", id_col="event_id")
    return rounded_all(autoencoder.train_autoencoder_on_rows(stored, length, is_train)[1])


# ---- graph

WIDTH = g.HIDDEN
FEATURES = ["f0", "f1", "f2"]


def weight(i: int, j: int) -> float:
    return (((i * 31 + j * 17) % 201) - 100) / 100 * 0.01


WEIGHTS = np.array([[weight(i, j) for j in range(WIDTH)] for i in range(len(FEATURES))])


def _projected(spark: SparkSession, folder: str) -> DataFrame:
    vectors = views.nodes(spark, folder).select("graph_id", "node_id", F.array(*FEATURES).alias("features"))
    return g.project_features(vectors, WEIGHTS)


def _spread(df: DataFrame, array: str, ids: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*ids, *[F.round(F.col(array)[i], digits).alias(n) for i, n in enumerate(names)])


@query("build_edges", over("v_edges", "select graph_id, src, dst, round(traffic, 4) as traffic, n_events from v_edges"))
def build_edges(spark: SparkSession, folder: str) -> DataFrame:
    return views.edges(spark, folder).withColumn("traffic", F.round("traffic", 4))


@query("edge_attributes", over(
    "v_edges",
    """select graph_id, src, dst, round(traffic, 4) as traffic, edge_count, round(traffic / busiest, 6) as traffic_share from v_edges
       join (select graph_id, count(*) as edge_count, max(traffic) as busiest from v_edges group by graph_id) g using (graph_id)""",
))
def edge_attributes(spark: SparkSession, folder: str) -> DataFrame:
    out = g.edge_attributes(cut_lineage(views.edges(spark, folder)))
    return out.select("graph_id", "src", "dst", F.round("traffic", 4).alias("traffic"), "edge_count", F.round("traffic_share", 6).alias("traffic_share"))


@query("neighbor_mean", over(
    "v_nodes v_edges",
    """select n.graph_id, n.node_id, round(coalesce(a0, 0), 5) as a0, round(coalesce(a1, 0), 5) as a1, round(coalesce(a2, 0), 5) as a2 from v_nodes n
       left join (select e.graph_id, e.dst as node_id, avg(f0) as a0, avg(f1) as a1, avg(f2) as a2 from v_edges e
                  join v_nodes s on s.graph_id = e.graph_id and s.node_id = e.src group by e.graph_id, e.dst) m
       on m.graph_id = n.graph_id and m.node_id = n.node_id""",
))
def neighbor_mean(spark: SparkSession, folder: str) -> DataFrame:
    h = cut_lineage(views.nodes(spark, folder).select("graph_id", "node_id", F.array(*FEATURES).alias("h")))
    out = g.neighbor_mean(g.count_edges(views.edges(spark, folder), h), h, 3)
    return _spread(out, "agg", ["graph_id", "node_id"], ["a0", "a1", "a2"], 5)


_PROJECT = "select graph_id, node_id, " + ", ".join(
    " + ".join(f"{f} * ((({i} * 31 + {j} * 17) % 201 - 100) / 100e0 * 0.01e0)" for i, f in enumerate(FEATURES)) + f" as h{j}" for j in range(WIDTH)
) + " from v_nodes"
_H = [f"h{j}" for j in range(WIDTH)]


def _layer(source: str) -> str:
    mixed = ", ".join(f"greatest(0.5e0 * n.{h} + 0.5e0 * coalesce(m.{h}, 0), 0e0) as {h}" for h in _H)
    means = ", ".join(f"avg(s.{h}) as {h}" for h in _H)
    return f"""select n.graph_id, n.node_id, {mixed} from {source} n left join (select e.graph_id, e.dst as node_id, {means} from v_edges e
        join {source} s on s.graph_id = e.graph_id and s.node_id = e.src group by e.graph_id, e.dst) m
        on m.graph_id = n.graph_id and m.node_id = n.node_id"""


_LAYERS = {"l0": _PROJECT, "l1": _layer("l0"), "l2": _layer("l1"), "l3": _layer("l2")}
_ROUND_H = ", ".join(f"{grid_sql(h, 6)} as {h}" for h in _H)
_EMBED = "select graph_id, " + ", ".join(f"avg({h}) as {h}" for h in _H) + " from l3 group by graph_id"


def _grid_h(df: DataFrame, array: str, ids: list[str]) -> DataFrame:
    return df.select(*ids, *[grid(F.col(array)[i], 6).alias(n) for i, n in enumerate(_H)])


@query("project_features", over("v_nodes", f"select graph_id, node_id, {_ROUND_H} from l0", l0=_PROJECT))
def project_features(spark: SparkSession, folder: str) -> DataFrame:
    return _grid_h(_projected(spark, folder), "h", ["graph_id", "node_id"])


def _embedded_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return g.forward(_projected(spark, folder), views.edges(spark, folder), WIDTH)


@query("gnn_forward", over("v_nodes v_edges", f"select graph_id, node_id, {_ROUND_H} from l3", **_LAYERS))
def gnn_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _grid_h(_embedded_nodes(spark, folder), "h", ["graph_id", "node_id"])


@query("graph_embedding", over("v_nodes v_edges", f"select graph_id, {_ROUND_H} from emb", **_LAYERS, emb=_EMBED))
def graph_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return _grid_h(g.graph_embedding(_embedded_nodes(spark, folder), WIDTH), "embedding", ["graph_id"])


@query("graph_score", over(
    "v_nodes v_edges",
    "select graph_id, round(least(1e0, sqrt(" + " + ".join(f"({h} - 0.5e0) * ({h} - 0.5e0)" for h in _H) + ") / 10e0), 6) as s_gnn from emb",
    **_LAYERS, emb=_EMBED,
))
def graph_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = g.graph_score(g.graph_embedding(_embedded_nodes(spark, folder), WIDTH), WIDTH)
    return rounded_all(scored.select("graph_id", "s_gnn"))


# ---- sampled graphs

def _stored_graphs(spark: SparkSession, folder: str) -> m.Graphs:
    return m.Graphs(cut_lineage(views.nodes(spark, folder), "nodes"), cut_lineage(views.edges(spark, folder), "edges"), FEATURES)


GRAPHS, SMALLEST, LARGEST = 100, 5, 24
_DRAW = [lehmer_unit_sql("node_id", "sample", tag) for tag in range(4)]
_SAMPLED = {
    "draws": f"select *, {_DRAW[1]} as first_draw, {_DRAW[2]} as draw from v_nodes, (select unnest(range(0, {GRAPHS})) as sample) s",
    "sizes": "select graph_id, count(*) as size from v_nodes group by graph_id",
    "chosen": f"""select sample, arg_min(graph_id, first_draw) as graph_id from draws
        where first_draw < least(1e0, {g.RIVALS}e0 / (select count(*) from v_nodes)) group by sample""",
    "offered": f"""select draws.*, row_number() over (partition by sample order by draw, node_id) as rank from draws join chosen using (sample, graph_id)
        join sizes using (graph_id) where draw < {LARGEST * g.SURPLUS}e0 / size""",
    "s_nodes": f"""select sample, graph_id, node_id, f0, f1, f2 from offered
        where rank <= {SMALLEST} + floor({lehmer_unit_sql("sample", "sample", 3)} * {LARGEST - SMALLEST + 1})""",
    "s_edges": """select a.sample, e.graph_id, e.src, e.dst, e.traffic, e.n_events from v_edges e join s_nodes a on a.graph_id = e.graph_id and a.node_id = e.src
        join s_nodes b on b.graph_id = e.graph_id and b.node_id = e.dst and a.sample = b.sample""",
}


@query("sample_graphs", over(
    "v_nodes v_edges",
    """select n.sample as graph_id, min(n.graph_id) as source_graph, count(*) as nodes, min(node_id) as first_id, coalesce(max(edges), 0) as edges,
       round(coalesce(max(traffic), 0), 4) as traffic from s_nodes n
       left join (select sample, count(*) as edges, sum(traffic) as traffic from s_edges group by sample) e on e.sample = n.sample group by n.sample""",
    **_SAMPLED,
))
def sample_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Size, smallest node, edges and traffic of subgraphs induced by sampled nodes."""
    stored = _stored_graphs(spark, folder)
    nodes, edges = g.sample_graphs(stored.nodes, stored.edges, graphs=GRAPHS, smallest=SMALLEST, largest=LARGEST, draw=lehmer_unit)
    counts = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("traffic").alias("traffic"))
    sizes = nodes.groupBy("graph_id").agg(F.min("source_graph").alias("source_graph"), F.count(F.lit(1)).alias("nodes"), F.min("node_id").alias("first_id"))
    traffic = F.round(F.coalesce("traffic", F.lit(0.0)), 4).alias("traffic")
    return sizes.join(counts, "graph_id", "left").select("graph_id", "source_graph", "nodes", "first_id", F.coalesce("edges", F.lit(0)).alias("edges"), traffic)


_BASELINE = {
    **_SAMPLED,
    "t_nodes": "select cast(sample as varchar) as graph_id, node_id, f0, f1, f2 from s_nodes",
    "t_edges": "select cast(sample as varchar) as graph_id, src, dst from s_edges",
    "t0": _PROJECT.replace("v_nodes", "t_nodes"),
    **{f"t{k}": _layer(f"t{k - 1}").replace("v_edges", "t_edges") for k in (1, 2, 3)},
    "temb": _EMBED.replace("l3", "t3"),
    "cells": "select unnest(range(0, " + str(WIDTH) + ")) as dimension, unnest([" + ", ".join(_H) + "]) as value from temb",
}


@query("graph_baseline", over(
    "v_nodes v_edges",
    f"""select cast(dimension as int) as dimension, count(*) as graphs, {grid_sql("avg(value)", 6)} as mean, {grid_sql("stddev_pop(value)", 6)} as std
        from cells group by dimension""",
    **_BASELINE,
))
def graph_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread, per dimension, of the embeddings of 100 sampled subgraphs."""
    stored = _stored_graphs(spark, folder)
    embedded = g.sampled_embeddings(stored.nodes, stored.edges, WEIGHTS, FEATURES, graphs=GRAPHS, smallest=SMALLEST, largest=LARGEST, draw=lehmer_unit)
    return g.embedding_spread(embedded).select("dimension", "graphs", grid(F.col("mean"), 6).alias("mean"), grid(F.col("std"), 6).alias("std"))


# ---- all detectors, with models that SQL can repeat

STEPS, SLOTS = schemas.SEQUENCE_LENGTH, 2 * len(DEFAULT_FEATURES)
ERROR_LIMIT, DECISION_OFFSET, DECISION_LIMIT = 2.5e13, -0.5, 0.15


def given_models(spark: SparkSession) -> m.Models:
    """Models with stated numbers: two components (level, and even against odd slots), the fixed forest, the fixed projection."""
    size = STEPS * SLOTS
    components = np.stack([np.ones(size), np.tile([1.0, -1.0], size // 2)]) / np.sqrt(size)
    coder = autoencoder.SequenceAutoencoder(PcaModel(np.zeros(size), components, np.zeros(2)), 0.0, ERROR_LIMIT)
    depth = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    nodes = small_table(spark, [(*n, depth[n[1]]) for n in FIXED_FOREST], schemas.FOREST_NODE)
    forest = iforest.IsolationForest(nodes, SLOTS, 8, 3, DECISION_OFFSET, -DECISION_LIMIT, DECISION_LIMIT)
    return m.Models(coder, forest, WEIGHTS, STEPS)


_FEATURE_COLUMNS = [f"f{i}" for i in range(len(DEFAULT_FEATURES))]
_STATISTICS = [f"avg({c})" for c in _FEATURE_COLUMNS] + [f"var_pop({c})" for c in _FEATURE_COLUMNS]
_PREDICTED = {
    **_LAYERS, "emb": _EMBED,
    "windows": f"""select epoch_ms(time_bucket(interval '6 hours', ts)) + 21600000 as timestamp, node_name,
        {", ".join(f"{x} as x{i}" for i, x in enumerate(_STATISTICS))} from v_features group by 1, 2""",
    "moments": "select *, " + " + ".join(f"x{i}" for i in range(SLOTS)) + " as level, " + " + ".join(f"{'-' if i % 2 else ''}x{i}" for i in range(SLOTS))
    + " as odd, " + " + ".join(f"x{i} * x{i}" for i in range(SLOTS)) + " as squares from windows",
    "errors": f"""select *, case when count(*) over w = {STEPS} then
        (sum(squares) over w - (power(sum(level) over w, 2) + power(sum(odd) over w, 2)) / {STEPS * SLOTS}e0) / {STEPS * SLOTS}e0 end as error
        from moments window w as (partition by node_name order by timestamp rows between {STEPS - 1} preceding and current row)""",
    "paths": f"""select *, ((case when x0 <= 20 then 1 + {_c(5)} when x1 <= 50 then 2 + {_c(2)} else 2 + {_c(1)} end)
        + (case when x1 <= 30 then 1 + {_c(3)} when x2 <= 100 then 2 + {_c(4)} else 2 + {_c(1)} end)
        + (case when x2 > 150 then 1 + {_c(1)} when x0 <= 60 then 2 + {_c(6)} else 2 + {_c(1)} end)) / 3e0 as path from errors""",
    "three": f"""select timestamp, node_name, case when error is not null then least(greatest(error / {ERROR_LIMIT!r}, 0e0), 1e0) end as s_lstm,
        least(greatest(({DECISION_LIMIT!r} - (-pow(2e0, -path / {_c(8)}) - ({DECISION_OFFSET!r}))) / {2 * DECISION_LIMIT!r}, 0e0), 1e0) as s_if,
        least(1e0, sqrt({" + ".join(f"({h} - 0.5e0) * ({h} - 0.5e0)" for h in _H)}) / 10e0) as s_gnn from paths left join emb on graph_id = node_name""",
    "fused": """select *, case when s_lstm is null then (0.28e0 * s_if + 0.25e0 * s_gnn) / 0.53e0
        else 0.47e0 * s_lstm + 0.28e0 * s_if + 0.25e0 * s_gnn end as score from three""",
}
_PREDICTION = over(
    "v_features v_nodes v_edges",
    f"""select timestamp, node_name, round(s_lstm, 6) as s_lstm, round(s_if, 6) as s_if, round(s_gnn, 6) as s_gnn, round(score, 6) as score,
        score >= 0.85e0 as is_anomaly, case when s_lstm is null then 'lstm' else '' end as missing_models, {ALERT_SQL} as alert_level, {ACTION_SQL} as action from fused""",
    **_PREDICTED,
)


def _raw_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Window statistics as they are, with ``ts`` and ``window_id``."""
    found = statistics(spark, folder, "6 hours").withColumns({"window_id": window_id(), "ts": F.timestamp_millis("timestamp")})
    return cut_lineage(found.drop("window_size"), "windows")


def _predicted(windows: DataFrame, models: m.Models, graphs: m.Graphs, graph_scores: DataFrame | None = None) -> DataFrame:
    rows = window_stretches(windows, models.length)
    scored = m.predict(windows, models, id_col="window_id", stretches=rows, graphs=graphs, graph=F.col("node_name"), graph_scores=graph_scores)
    return rounded_all(fused_actions(scored))


@query("ensemble_predict", _PREDICTION)
def ensemble_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Scores, fusion and action of every (node, window) by its real sequence and graph."""
    return _predicted(_raw_windows(spark, folder), given_models(spark), _stored_graphs(spark, folder))


@query("model_roundtrip", _PREDICTION)
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The same by models that were stored and read back."""
    loaded = m.load_models(spark, m.save_models(given_models(spark), spark, scratch_path(spark, "models")))
    return _predicted(_raw_windows(spark, folder), loaded, _stored_graphs(spark, folder))


@query("entry")
def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry to a recommended action per node and window."""
    actions = window_actions(
        views.telemetry(spark, folder), views.nodes(spark, folder), views.edges(spark, folder), node_features=FEATURES
    )
    return rounded_all(actions)


# ---- streams

@query("stream_windows", over(
    "v_features",
    f"select * from stats where timestamp <= (select epoch_us(max(ts)) // 1000 - 120000 from events)",
    stats=window_sql("6 hours", 21600),
))
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows closed by the final watermark, two minutes behind the last event."""
    telemetry = views.telemetry(spark, folder)
    location = scratch_path(spark, "telemetry-table")
    telemetry.write.parquet(location)
    stream = readers.open_records(spark, location, telemetry.schema, streaming=True)
    return split_statistics(finish(jobs.feature_windows(stream, length="6 hours"), spark, "stream-windows"))


@query("feature_json_stream", over(
    "v_features", "select * from stats where timestamp <= (select epoch_us(max(ts)) // 1000 - 120000 from events)", stats=window_sql("6 hours", 21600)
))
def feature_json_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Closed windows streamed out as JSON text, one record a line, and read back."""
    source = views.telemetry(spark, folder)
    location = scratch_path(spark, "telemetry-table")
    source.write.parquet(location)
    stream = jobs.feature_windows(readers.open_records(spark, location, source.schema, streaming=True), length="6 hours")
    out = scratch_path(spark, "feature-json")
    lines = stream.select(writers.feature_json(F.col("timestamp"), F.col("node_name"), F.col("features"), F.col("window_size")).alias("value"))
    writers.stream_to(lines, out, scratch_path(spark, "feature-json-progress"), fmt="text").awaitTermination()
    parsed = readers.open_values(spark, out).select(F.from_json("value", schemas.FEATURE_WINDOW).alias("r")).select("r.*")
    return split_statistics(parsed)


@query("stream_scoring", _PREDICTION)
def stream_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a stream: a batch of the first windows starts the state, and micro-batches go on from there."""
    windows = _raw_windows(spark, folder).drop("window_id", "ts")
    graphs, models = _stored_graphs(spark, folder), given_models(spark)
    per_graph = cut_lineage(m.score_graphs(graphs, models), "graph-scores")
    ends = windows.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    borders = [ends["lo"] + (ends["hi"] - ends["lo"]) * i // 10 for i in (2, 5, 7, 10)]
    location = scratch_path(spark, "window-vectors")
    for after, upto in zip(borders[:-1], borders[1:], strict=True):  # files are read in the order of their times
        windows.where((F.col("timestamp") > after) & (F.col("timestamp") <= upto)).coalesce(1).write.mode("append").parquet(location)
    stream = readers.open_records(spark, location, windows.schema, streaming=True, options={"maxFilesPerTrigger": "1"})
    past = windows.where(F.col("timestamp") <= borders[0])
    scored = finish(jobs.score_sequences(stream, models, per_graph, history=past), spark, "stream-scoring")
    first = past.withColumns({"window_id": window_id(), "ts": F.timestamp_millis("timestamp")})
    return rounded_all(scored).unionByName(_predicted(cut_lineage(first, "first-windows"), models, graphs, per_graph))


def _window_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean fused score per node and hour."""
    hourly = fused(spark, folder).groupBy("node_name", F.window("ts", "1 hour").alias("w")).agg(F.avg("score").alias("score"))
    return hourly.select("node_name", F.unix_millis(F.col("w.end").cast("timestamp")).alias("timestamp"), F.round("score", 6).alias("score"))


@query("stream_consecutive", over(
    "v_fused",
    """select node_name as entity, timestamp, cast(run_length as int) as run_length from (
         select *, row_number() over (partition by node_name, island, score >= 0.45e0 order by timestamp) as run_length from (
           select *, row_number() over (partition by node_name order by timestamp)
             - row_number() over (partition by node_name, score >= 0.45e0 order by timestamp) as island from hourly) i) r
       where score >= 0.45e0 and run_length >= 3""",
    hourly="select node_name, epoch_ms(time_bucket(interval '1 hour', ts)) + 3600000 as timestamp, round(avg(score), 6) as score from v_fused group by 1, 2",
))
def stream_consecutive(spark: SparkSession, folder: str) -> DataFrame:
    """Runs kept as state across micro-batches."""
    hourly = _window_scores(spark, folder)
    location = scratch_path(spark, "window-scores")
    hourly.write.parquet(location)
    stream = readers.open_records(spark, location, hourly.schema, streaming=True)
    return finish(jobs.consecutive_runs(stream, threshold=0.45), spark, "stream-consecutive")
