"""Message passing over relationship graphs held as node and edge tables.

Nodes: ``graph_id, node_id, h`` (array). Edges: ``graph_id, src, dst`` and optionally
``traffic``. Every step is a join and a grouped aggregate over all graphs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden.functions.ordered import chunk_window, frame_chunks, own_rows
from telewarden.functions.skew import BROADCAST_ROWS, find_hot_keys, is_small, lookup_join, repeat, spread, unit_hash
from telewarden.functions.vector_sums import sum_columns_by_key
from telewarden.functions.vectors import distance, is_complete, multiply, multiply_written_out, positive
from telewarden.session import cut_lineage, small_table

HIDDEN, LAYERS, ALPHA, DROPOUT = 128, 3, 0.5, 0.2
_SOURCE = ["graph_id", "src"]
WEIGHT_SCALE, REFERENCE, DISTANCE_SCALE = 0.01, 0.5, 10.0
#: Weights of a projection that is written out as columns.
WRITTEN_OUT = 1_024


def transition_events(df: DataFrame, *, graph: str, node: str, order: Sequence[str]) -> DataFrame:
    """Event by event, the node seen before in the same graph as ``src`` and this one as ``dst``."""
    chunks = frame_chunks(df, [graph], order, order[0], 2)
    linked = own_rows(chunks.withColumn("src", F.lag(node).over(chunk_window([graph]))))
    return linked.where(F.col("src").isNotNull()).withColumn("dst", F.col(node)).drop("pos")


def build_edges(events: DataFrame, *, graph: str = "graph_id", src: str = "src", dst: str = "dst", traffic: str = "traffic") -> DataFrame:
    return events.groupBy(graph, src, dst).agg(F.sum(traffic).alias("traffic"), F.count(F.lit(1)).alias("n_events"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Every node at either end of an edge."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.distinct()


def edge_attributes(edges: DataFrame) -> DataFrame:
    """Add the graph's edge count and the traffic share of its busiest edge; no traffic at all gives null. Pass stored edges."""
    per_graph = cut_lineage(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"), F.max("traffic").alias("_max")))
    return (
        lookup_join(edges, per_graph, ["graph_id"])
        .withColumn("traffic_share", F.try_divide(F.col("traffic").cast("double"), F.col("_max").cast("double")))
        .drop("_max")
    )


def projection_matrix(d: int, hidden: int = HIDDEN, *, seed: int = 42) -> np.ndarray:
    """Seeded normal weights, so scores are reproducible; store it with the model."""
    return np.random.default_rng(seed).normal(size=(d, hidden)) * WEIGHT_SCALE


def matrix_table(spark, matrix: np.ndarray) -> DataFrame:
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(matrix)]
    return small_table(spark, rows, "i int, w array<double>")


def matrix_from_table(table: DataFrame) -> np.ndarray:
    """One row per feature."""
    return np.array([r["w"] for r in sorted(table.collect(), key=lambda r: r["i"])])


def project_features(nodes: DataFrame, matrix: np.ndarray, *, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """``h`` of each node, and columns to ``keep``; a narrow projection is done in the JVM, a wide one in Arrow batches."""
    project = multiply_written_out if np.size(matrix) <= WRITTEN_OUT else multiply
    return nodes.select("graph_id", "node_id", *keep, project(F.col(features), matrix).alias("h"))


#: Targets that are added up together and sources that send to them in one task, in expectation.
BLOCK_NODES, STRIPE_NODES = 1 << 13, 1 << 16
_MEETING = ["graph_id", "block", "stripe"]


@dataclass(frozen=True)
class CountedEdges:
    """Stored distinct edges with their multiplicity, and how they will meet their source nodes.

    A row has the ``targets`` of a source that lie in one ``block`` of its graph's nodes, so its vector is sent once per block instead of
    once per edge. With ``few_nodes`` the nodes are broadcast; otherwise edges are shuffled, salted where the source is one of ``hot``.
    """

    table: DataFrame
    few_nodes: bool
    hot: DataFrame | None = None


def count_edges(edges: DataFrame, nodes: DataFrame, *, small_rows: int = BROADCAST_ROWS) -> CountedEdges:
    return _deal_edges(_distinct_edges(edges), nodes, small_rows)


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("times")))


def _deal_edges(distinct: DataFrame, nodes: DataFrame, small_rows: int) -> CountedEdges:
    few = is_small(nodes, small_rows)
    hot = None if few else find_hot_keys(distinct, _SOURCE)
    sizes = cut_lineage(nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_size")), "graph-sizes")
    parts = {"block": ("dst", BLOCK_NODES), "stripe": ("src", STRIPE_NODES)}
    dealt = lookup_join(distinct, sizes, ["graph_id"]).withColumns(
        {name: F.pmod(F.xxhash64(end), F.ceil(F.col("_size") / F.lit(most))) for name, (end, most) in parts.items()}
    )
    salted = dealt.drop("_size") if hot is None else spread(dealt.drop("_size"), _SOURCE, hot)
    ids = [c for c in salted.columns if c not in ("dst", "times")]
    return CountedEdges(cut_lineage(salted.groupBy(*ids).agg(F.collect_list(F.struct("dst", "times")).alias("targets")), "edges"), few, hot)


def neighbor_mean(counted: CountedEdges, nodes: DataFrame, width: int) -> DataFrame:
    """Mean ``h`` of the sources of each node's in-edges as ``agg``; duplicate edges count again, no in-edge gives 0.

    Sources without a complete vector are left out.
    """
    means = neighbor_sums(counted, nodes, width).select("graph_id", "node_id", _mean().alias("agg"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return nodes.join(means, ["graph_id", "node_id"], "left").withColumn("agg", F.coalesce("agg", zeros))


def neighbor_sums(counted: CountedEdges, nodes: DataFrame, width: int) -> DataFrame:
    """``graph_id, node_id, n, total``: number and sum of the complete ``h`` of the sources of a node's in-edges, for nodes with any.

    Sources meet by blocks of targets, whose sums a task holds, and by stripes of sources, so a hot target is added up in many tasks.
    """
    source = nodes.select("graph_id", F.col("node_id").alias("src"), "h")
    if counted.few_nodes:
        sent = counted.table.join(F.broadcast(source), _SOURCE)
    elif counted.hot is None:
        sent = counted.table.join(source, _SOURCE)
    else:
        salted = repeat(source, _SOURCE, counted.hot)
        sent = counted.table.join(salted, [c for c in salted.columns if c != "h"])
    met = sent.select(*_MEETING, "h", "targets").repartition(*_MEETING)
    single = met.select("graph_id", "h", F.inline("targets")).withColumnRenamed("dst", "node_id")
    return sum_columns_by_key(single, ["graph_id", "node_id"], "h", width, weight="times")


def _mean() -> Column:
    return F.transform("total", lambda x: x / F.col("n"))


def combine(own: Column, agg: Column, alpha: float = ALPHA) -> Column:
    """``relu(alpha * own + (1 - alpha) * agg)`` elementwise."""
    return F.zip_with(own, agg, lambda a, b: positive(F.lit(alpha) * a + F.lit(1 - alpha) * b))


def _drop_out(df: DataFrame, layer: int, rate: float, seed: int) -> DataFrame:
    """Inverted dropout whose mask depends on node, position and seed only."""
    kept = F.transform(
        F.col("h"),
        lambda x, j: F.when(unit_hash(F.col("graph_id"), F.col("node_id"), j, F.lit(layer), F.lit(seed)) < 1 - rate, x / F.lit(1 - rate)).otherwise(0.0),
    )
    return df.withColumn("h", kept)


def forward(
    nodes: DataFrame,
    edges: DataFrame,
    width: int,
    *,
    layers: int = LAYERS,
    alpha: float = ALPHA,
    training: bool = False,
    dropout: float = DROPOUT,
    seed: int = 42,
    small_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Node embeddings after ``layers`` rounds. Each round is stored, as the next reads it twice."""
    h = cut_lineage(nodes.select("graph_id", "node_id", "h"))
    counted = count_edges(edges, h, small_rows=small_rows)
    for layer in range(layers):
        h = neighbor_mean(counted, h, width).select("graph_id", "node_id", combine(F.col("h"), F.col("agg"), alpha).alias("h"))
        if training and dropout > 0:
            h = _drop_out(h, layer, dropout, seed)
        if layer < layers - 1:
            h = cut_lineage(h)
    return h


def graph_embedding(nodes: DataFrame, width: int) -> DataFrame:
    """Mean of the complete node embeddings per graph; a graph without any is left out."""
    return sum_columns_by_key(nodes, ["graph_id"], "h", width).select("graph_id", _mean().alias("embedding"))


#: Features and weights up to this size can be multiplied and added up without overflow.
_TAME = 1e100


def embed_graphs(
    nodes: DataFrame, edges: DataFrame, matrix: np.ndarray, *, layers: int = LAYERS, alpha: float = ALPHA, small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The ``graph_embedding`` of ``forward`` over projected ``features``, without the embeddings of nodes.

    The first layer rectifies the projection of a node's features mixed with their mean over its sources, as projections and means may be
    swapped. From then on no entry is below 0 and a layer is linear, so the mean over all nodes after the last layer is a sum of the first
    layer's vectors, each with a weight. Weights start at 1 and go back over the edges, from targets to sources, once per layer. An edge
    carries the features once and then one number per layer, instead of ``h`` every time. Numbers that might overflow, and so lose a vector
    on the way, take the path through all layers.
    """
    matrix = np.asarray(matrix, dtype=np.float64)
    d, width = matrix.shape
    key = ["graph_id", "node_id"]
    own = cut_lineage(nodes.where(is_complete(F.col("features"))).select(*key, F.col("features").cast("array<double>").alias("h")), "complete-nodes")
    seen = own.agg(F.max(F.array_max(F.transform("h", F.abs))).alias("most"), F.min(F.size("h")).alias("lo"), F.max(F.size("h")).alias("hi")).first()
    tame = (seen["most"] or 0.0) <= _TAME and bool((np.abs(matrix) <= _TAME).all()) and {seen["lo"], seen["hi"]} <= {d, None}
    if not tame or layers < 1 or not 0 <= alpha <= 1 or d > width:
        projected = project_features(nodes, matrix)
        return graph_embedding(forward(projected, edges, width, layers=layers, alpha=alpha, small_rows=small_rows), width)
    distinct = _distinct_edges(edges)
    sums = cut_lineage(neighbor_sums(_deal_edges(distinct, own, small_rows), own, d), "neighbor-sums")
    weights = own.select(*key, F.lit(1.0).alias("u"))
    if layers > 1:
        back = _deal_edges(distinct.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "times"), own, small_rows)
    for _ in range(layers - 1):
        shares = weights.join(sums.select(*key, "n"), key).select(*key, F.array(F.col("u") / F.col("n")).alias("h"))
        sent = neighbor_sums(back, shares, 1).select(*key, F.col("total")[0].alias("_back"))
        mixed = F.lit(alpha) * F.col("u") + F.lit(1 - alpha) * F.coalesce("_back", F.lit(0.0))
        weights = cut_lineage(weights.join(sent, key, "left").select(*key, mixed.alias("u")), "node-weights")
    agg = F.coalesce(_mean(), F.array_repeat(F.lit(0.0), d))
    mixed = F.zip_with("h", agg, lambda a, b: F.lit(alpha) * a + F.lit(1 - alpha) * b)
    met = own.join(sums, key, "left").join(weights, key).select(*key, "u", mixed.alias("features"))
    # Stored, as each of the sums below would write the projection out anew.
    first = cut_lineage(project_features(met, matrix, keep=["u"]).withColumn("h", F.transform("h", positive)), "first-layer")
    sizes = own.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_size"))
    total = sum_columns_by_key(first, ["graph_id"], "h", width, weight="u").join(sizes, "graph_id")
    return total.select("graph_id", F.transform("total", lambda x: x / F.col("_size")).alias("embedding"))


def distance_score(embedding: Column, reference: Column) -> Column:
    """At most 1; null for an embedding that is null or incomplete."""
    return F.when(is_complete(embedding), F.least(F.lit(1.0), distance(embedding, reference) / F.lit(DISTANCE_SCALE)))


def graph_score(embeddings: DataFrame, width: int, reference: Sequence[float] | None = None) -> DataFrame:
    """Add ``s_gnn``: distance to a reference embedding (0.5 everywhere by default), at most 1."""
    ref = [REFERENCE] * width if reference is None else list(reference)
    return embeddings.withColumn("s_gnn", distance_score(F.col("embedding"), F.array(*[F.lit(float(r)) for r in ref])))


def single_node_score(features: Column, matrix: np.ndarray, *, layers: int = LAYERS, alpha: float = ALPHA, reference: Sequence[float] | None = None) -> Column:
    """Score of a graph of one node without edges, as a pure projection."""
    width = np.asarray(matrix).shape[1]
    ref = [REFERENCE] * width if reference is None else list(reference)
    h = F.transform(multiply(features, matrix), lambda x: positive(x) * F.lit(float(alpha**layers)))
    return distance_score(h, F.array(*[F.lit(float(r)) for r in ref]))


Draw = Callable[[Column, Column, int], Column]


def seeded_draw(seed: int) -> Draw:
    return lambda node, sample, tag: unit_hash(node, sample, F.lit(tag), F.lit(seed))


#: Rows that compete for a place in a sample, in expectation: so many for its graph, and so many times its size for its nodes.
RIVALS, SURPLUS = 64, 4


def sample_graphs(
    nodes: DataFrame, edges: DataFrame, *, graphs: int = 100, smallest: int = 5, largest: int = 24, draw: Draw | None = None
) -> tuple[DataFrame, DataFrame]:
    """Induced subgraphs: ``smallest..largest`` nodes of one graph each, with all edges between them. Pass stored tables.

    The graph of a sample is that of the node of smallest draw, so large graphs are met more often; its nodes are those of smallest
    draw in the graph. Both results have ``graph_id`` (the sample's number) and ``source_graph``; edges keep their columns. Draws depend on
    ids only. A sampled table has at most ``graphs * largest`` rows, so it is broadcast to the edges, whose ends may be hot.
    """
    draw = draw or seeded_draw(42)
    node, sample = F.col("node_id"), F.col("sample")
    samples = F.sequence(F.lit(0), F.lit(graphs - 1))
    sizes = cut_lineage(nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")), "graph-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 1
    rivals = nodes.select("graph_id", "node_id", F.explode(F.filter(samples, lambda s: draw(node, s, 1) < min(1.0, RIVALS / total))).alias("sample"))
    firsts = rivals.groupBy("sample").agg(F.min(F.struct(draw(node, sample, 1).alias("h"), "graph_id", "node_id")).alias("first"))
    chosen = firsts.select("sample", F.col("first.graph_id").alias("graph_id")).groupBy("graph_id").agg(F.collect_list("sample").alias("samples"))
    drawn_for = nodes.join(F.broadcast(chosen), "graph_id").join(sizes, "graph_id")  # at most ``graphs`` rows are broadcast
    share = F.lit(float(largest * SURPLUS)) / F.col("size")
    offered = drawn_for.withColumn("sample", F.explode(F.filter("samples", lambda s: draw(node, s, 2) < share)))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(draw(node, sample, 2), "node_id"))
    wanted = F.lit(smallest) + F.floor(draw(sample, sample, 3) * (largest - smallest + 1))
    kept = offered.withColumn("rank", rank).where(F.col("rank") <= wanted).drop("rank", "samples", "size")
    sampled = cut_lineage(kept.withColumnRenamed("graph_id", "source_graph").withColumnRenamed("sample", "graph_id"), "sampled-nodes")

    def end(name: str) -> DataFrame:
        return F.broadcast(sampled.select("source_graph", "graph_id", F.col("node_id").alias(name)))

    inside = edges.withColumnRenamed("graph_id", "source_graph").join(end("src"), ["source_graph", "src"]).join(end("dst"), ["source_graph", "graph_id", "dst"])
    return sampled, inside


def baseline(nodes: DataFrame, edges: DataFrame, matrix: np.ndarray, features: Sequence[str], **sampling) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the embeddings of sampled subgraphs, dimension by dimension: what a graph usually looks like."""
    found = embedding_spread(sampled_embeddings(nodes, edges, matrix, features, **sampling)).orderBy("dimension").collect()
    return np.array([r["mean"] for r in found]), np.array([r["std"] for r in found])


def sampled_embeddings(nodes: DataFrame, edges: DataFrame, matrix: np.ndarray, features: Sequence[str], **sampling) -> DataFrame:
    some, between = sample_graphs(nodes, edges, **sampling)
    vectors = some.select("graph_id", "node_id", F.array(*features).alias("features"))
    width = matrix.shape[1]
    return graph_embedding(forward(project_features(vectors, matrix), between.select("graph_id", "src", "dst"), width), width)


def embedding_spread(embeddings: DataFrame) -> DataFrame:
    """``dimension, graphs, mean, std`` over one embedding per graph."""
    cells = embeddings.select(F.posexplode("embedding").alias("dimension", "value"))
    return cells.groupBy("dimension").agg(F.count(F.lit(1)).alias("graphs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
