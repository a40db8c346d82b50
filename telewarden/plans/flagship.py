"""From telemetry to a recommended action per node and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.operators.autoencoder import ENCODING_DIM
from telewarden.operators.ensemble import detect, fuse_scores
from telewarden.operators.features import DEFAULT_FEATURES, with_features
from telewarden.operators.iforest import TREES
from telewarden.operators.policy import alert_level, recommend_action
from telewarden.operators.scaling import fit_scale
from telewarden.operators.sequence_moments import stretches
from telewarden.operators.windows import window_statistics
from telewarden.plans import models as m
from telewarden.session import cut_lineage

FEATURE_COLUMNS = [f"f{i}" for i in range(len(DEFAULT_FEATURES))]
#: Window statistics of all features: their means, then their variances.
STATISTIC_COLUMNS = [f"{kind}{i}" for kind in ("m", "v") for i in range(len(DEFAULT_FEATURES))]


def window_id() -> Column:
    """A stable number for a (node, window) row."""
    return F.xxhash64("node_name", "timestamp")


def scaled_windows(telemetry: DataFrame, *, length: str) -> DataFrame:
    """Window statistics with every slot standardised, plus ``ts`` and ``window_id``."""
    stats = window_statistics(with_features(telemetry), FEATURE_COLUMNS, length=length)
    wide = stats.select(
        window_id().alias("window_id"), F.timestamp_millis("timestamp").alias("ts"), "timestamp", "node_name", "window_size",
        *[F.col("features")[i].alias(c) for i, c in enumerate(STATISTIC_COLUMNS)],
    )
    stored = cut_lineage(wide)
    return fit_scale(stored, STATISTIC_COLUMNS).withColumn("features", F.array(*STATISTIC_COLUMNS)).drop(*STATISTIC_COLUMNS)


def window_actions(
    telemetry: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *,
    node_features: list[str],
    length: str = "6 hours",
    steps: int = schemas.SEQUENCE_LENGTH,
    encoding_dim: int = ENCODING_DIM,
    trees: int = TREES,
    threshold: float = schemas.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Three detectors on real sequences and real graphs, trained and applied, fused, with alert level and action.

    Every window comes out. A node's first ``steps - 1`` windows have no full sequence and a node may be in no graph; such
    scores are null, ``missing_models`` names them, and the others are weighted up.
    """
    windows = cut_lineage(scaled_windows(telemetry, length=length), "windows")
    rows = window_stretches(windows, steps)
    graphs = m.Graphs(cut_lineage(nodes, "nodes"), cut_lineage(edges, "edges"), node_features)
    trained = m.train_all(windows, id_col="window_id", stretches=rows, graphs=graphs, length=steps, encoding_dim=encoding_dim, trees=trees)
    return fused_actions(m.predict(windows, trained, id_col="window_id", stretches=rows, graphs=graphs, graph=F.col("node_name")), threshold)


def window_stretches(windows: DataFrame, steps: int = schemas.SEQUENCE_LENGTH) -> DataFrame:
    return stretches(windows, F.col("features"), keys=["node_name"], order=["ts"], length=steps, keep=["window_id"])


def fused_actions(scored: DataFrame, threshold: float = schemas.DEFAULT_THRESHOLD) -> DataFrame:
    """Scored windows with fused score, what it lacks, level and action."""
    fused = detect(fuse_scores(scored, allow_missing=True), threshold)
    return fused.select(
        "timestamp", "node_name", "s_lstm", "s_if", "s_gnn", "score", "is_anomaly", F.concat_ws(",", "missing_models").alias("missing_models"),
        alert_level(F.col("score")).alias("alert_level"), recommend_action(F.col("score")).alias("action"),
    )
