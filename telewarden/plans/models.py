"""Training, storing and applying the three detectors together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.functions.skew import lookup_join
from telewarden.operators import graph as g
from telewarden.operators.autoencoder import ENCODING_DIM, SequenceAutoencoder, fit_autoencoder, fit_autoencoder_on_rows
from telewarden.operators.iforest import CONTAMINATION, TREES, IsolationForest, fit_iforest
from telewarden.operators.sequence_moments import complete_sequences
from telewarden.operators.sequences import flatten_sequence, tile_sequence
from telewarden.schemas import SEQUENCE_LENGTH
from telewarden.session import cut_lineage, small_table
from telewarden.sources.readers import read_model
from telewarden.sources.writers import save_model


@dataclass(frozen=True)
class Models:
    """Fitted detectors. ``length`` is the sequence length the autoencoder was trained on; it is None where there was no sequence.

    ``reference`` and ``spread`` are mean and deviation of the embeddings of sampled graphs; without them graphs are held against 0.5.
    """

    autoencoder: SequenceAutoencoder | None
    forest: IsolationForest
    projection: np.ndarray
    length: int
    reference: np.ndarray | None = None
    spread: np.ndarray | None = None


@dataclass(frozen=True)
class Graphs:
    """Relationship graphs: stored nodes with feature columns, and edges."""

    nodes: DataFrame
    edges: DataFrame
    features: Sequence[str]


def train_all(
    df: DataFrame,
    *,
    id_col: str,
    features: str = "features",
    stretches: DataFrame | None = None,
    graphs: Graphs | None = None,
    length: int = SEQUENCE_LENGTH,
    encoding_dim: int = ENCODING_DIM,
    hidden: int = g.HIDDEN,
    trees: int = TREES,
    contamination: float = CONTAMINATION,
    seed: int = 42,
) -> Models:
    """Fit the forest on the vectors, the autoencoder on ``stretches`` of them, the graph baseline on subgraphs of ``graphs``.

    Without stretches each vector is repeated ``length`` times; without graphs a vector counts as a graph of one node.
    """
    forest = fit_iforest(df, id_col=id_col, features=features, trees=trees, contamination=contamination, seed=seed)
    if stretches is None:
        flat = df.select(flatten_sequence(tile_sequence(F.col(features), length)).alias("flat"))
        coder = fit_autoencoder(flat, "flat", encoding_dim)
    else:
        coder = fit_autoencoder_on_rows(stretches, length, encoding_dim) if complete_sequences(stretches, length) else None
    if graphs is None:
        return Models(coder, forest, g.projection_matrix(forest.width, hidden, seed=seed), length)
    projection = g.projection_matrix(len(graphs.features), hidden, seed=seed)
    reference, spread = g.baseline(graphs.nodes, graphs.edges, projection, graphs.features, draw=g.seeded_draw(seed))
    return Models(coder, forest, projection, length, reference, spread)


def score_vectors(df: DataFrame, models: Models, *, features: str = "features") -> DataFrame:
    """Add ``s_lstm, s_if, s_gnn`` from a feature vector alone, for records without history: constant sequence, one-node graph.

    Only projections, so it serves batches and streams.
    """
    tiled = df.withColumn("_flat", flatten_sequence(tile_sequence(F.col(features), models.length)))
    scored = models.forest.score(models.autoencoder.score(tiled, "_flat").drop("_flat"), features)
    return scored.withColumn("s_gnn", g.single_node_score(F.col(features), models.projection, reference=models.reference))


def score_graphs(graphs: Graphs, models: Models) -> DataFrame:
    """``graph_id, s_gnn``: distance of each graph's embedding to the models' reference."""
    vectors = graphs.nodes.select("graph_id", "node_id", F.array(*graphs.features).alias("features"))
    embedded = g.embed_graphs(vectors, graphs.edges, models.projection)
    return g.graph_score(embedded, models.projection.shape[1], models.reference).select("graph_id", "s_gnn")


def predict(
    df: DataFrame,
    models: Models,
    *,
    id_col: str,
    stretches: DataFrame,
    graphs: Graphs,
    graph: Column,
    features: str = "features",
    graph_scores: DataFrame | None = None,
) -> DataFrame:
    """Add ``s_lstm`` of the real sequence that ends at each row, ``s_if`` of its vector and ``s_gnn`` of the graph it belongs to.

    ``stretches`` keep ``id_col``. A row without a full sequence, a complete vector or a graph has a null there. ``graph_scores`` are
    the stored ``score_graphs`` of ``graphs``, if they are known.
    """
    scored = models.forest.score(df, features)
    if models.autoencoder is None:
        scored = scored.withColumn("s_lstm", F.lit(None).cast("double"))
    else:
        scored = scored.join(models.autoencoder.score_rows(stretches, models.length).select(id_col, "s_lstm"), id_col, "left")
    known = cut_lineage(score_graphs(graphs, models), "graph-scores") if graph_scores is None else graph_scores
    per_graph = known.withColumnRenamed("graph_id", "_graph")
    return lookup_join(cut_lineage(scored.withColumn("_graph", graph), "scored"), per_graph, ["_graph"], "left").drop("_graph")


def save_models(models: Models, spark: SparkSession, location: str) -> str:
    """Store as a new version, which readers see once all of it is there."""
    metadata = small_table(
        spark,
        [(models.length, int(models.projection.shape[0]), int(models.projection.shape[1]), models.forest.trees)],
        "length int, node_feature_dim int, hidden_dim int, trees int",
    )
    known = models.reference is not None
    baseline = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(models.reference, models.spread, strict=True))] if known else []
    parts = {
        **(models.autoencoder.to_tables(spark) if models.autoencoder else {}),
        **models.forest.to_tables(),
        "projection": g.matrix_table(spark, models.projection),
        "graph_baseline": small_table(spark, baseline, "dimension int, mean double, std double"),
        "metadata": metadata,
    }
    return save_model(parts, location)


def load_models(spark: SparkSession, location: str) -> Models:
    """Load every part of the newest version; a missing one fails."""
    table = read_model(spark, location)
    baseline = sorted(table["graph_baseline"].collect(), key=lambda r: r["dimension"])  # one row per embedding dimension
    return Models(
        SequenceAutoencoder.from_tables(table["autoencoder"], table["autoencoder_bounds"]) if "autoencoder" in table else None,
        IsolationForest.from_tables(table["forest"], table["forest_meta"]),
        g.matrix_from_table(table["projection"]),
        table["metadata"].first()["length"],
        np.array([r["mean"] for r in baseline]) if baseline else None,
        np.array([r["std"] for r in baseline]) if baseline else None,
    )
