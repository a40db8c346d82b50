"""Structured Streaming jobs built from the batch functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from telewarden import schemas
from telewarden.functions.vectors import known
from telewarden.operators.autoencoder import SequenceAutoencoder
from telewarden.operators.ensemble import detect, fixed_minmax, fuse_scores
from telewarden.operators.features import DEFAULT_FEATURES, with_features
from telewarden.operators.policy import RUN_LENGTH, alert_level, recommend_action
from telewarden.operators.windows import window_statistics
from telewarden.plans.flagship import fused_actions
from telewarden.plans.models import Models, score_vectors

DEFAULT_DELAY = "2 minutes"


def timed(df: DataFrame, time_col: str = "ts", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Event time with a watermark; rows later than ``delay`` are dropped and counted by Spark."""
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def feature_windows(telemetry: DataFrame, *, length: str = schemas.WINDOW_LENGTH, slide: str | None = None, delay: str = DEFAULT_DELAY, width: int | None = None) -> DataFrame:
    """Parsed telemetry to windowed feature records; emits a window once the watermark has passed its end."""
    cols = [f"f{i}" for i in range(len(DEFAULT_FEATURES))]
    return window_statistics(with_features(timed(telemetry, delay=delay)), cols, length=length, slide=slide, width=width)


def score_features(features: DataFrame, models: Models, *, threshold: float = schemas.DEFAULT_THRESHOLD) -> DataFrame:
    """Feature records to scored records: a stateless projection with bounds frozen at fit time."""
    scored = detect(fuse_scores(score_vectors(features, models)), threshold)
    return scored.withColumns({"alert_level": alert_level(F.col("score")), "action": recommend_action(F.col("score"))})


class SequenceScorer(StatefulProcessor):
    """Reconstruction error of each record's last ``length`` vectors, of which an entity's state keeps all but the newest.

    A record that is not later than the entity's last one has no error and does not enter the state.
    """

    def __init__(self, autoencoder: SequenceAutoencoder, length: int, time_col: str):
        self.mean, self.components = autoencoder.pca.mean, autoencoder.pca.components
        self.length, self.width, self.time_col = length, len(autoencoder.pca.mean) // length, time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "last bigint, steps binary")

    def _step(self, features) -> np.ndarray:
        x = np.full(self.width, np.nan) if features is None else np.array([np.nan if v is None else v for v in features], float)
        return x if len(x) == self.width else np.full(self.width, np.nan)

    def _advance(self, batch: pd.DataFrame) -> list[float | None]:
        last, stored = self.recent.get() if self.recent.exists() else (None, b"")
        steps = list(np.frombuffer(stored).reshape(-1, self.width))
        errors: list[float | None] = []
        for t, features in zip(batch[self.time_col], batch["features"], strict=True):
            if last is not None and t <= last:
                errors.append(None)
                continue
            last = int(t)
            steps = [*steps[-(self.length - 1) :], self._step(features)] if self.length > 1 else [self._step(features)]
            centred = np.concatenate(steps) - self.mean if len(steps) == self.length else np.array([np.nan])
            if np.isnan(centred).any():
                errors.append(None)
            else:
                missed = centred - (self.components @ centred) @ self.components
                errors.append(float(np.mean(missed * missed)))
        if last is not None:
            self.recent.update((last, b"".join(s.tobytes() for s in steps)))
        return errors

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._advance(initialState.sort_values(self.time_col))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(self.time_col, kind="stable")
        yield batch.assign(error=pd.Series(self._advance(batch), index=batch.index, dtype="float64"))

    def close(self) -> None:
        pass


def sequence_errors(
    features: DataFrame, autoencoder: SequenceAutoencoder, length: int, *, entity: str = "node_name", time_col: str = "timestamp", history: DataFrame | None = None
) -> DataFrame:
    """Add ``error`` of the sequence that ends at each record, null for an entity's first ``length - 1``.

    ``history`` are earlier records whose last ones start the state, so a stream goes on where a batch ended; give each
    entity's last ``length - 1``. Records of an entity must reach the stream in time order across batches.
    """
    use_rocksdb(features.sparkSession)
    past = None if history is None else history.select(entity, time_col, "features").groupBy(entity)
    return features.groupBy(entity).transformWithStateInPandas(
        SequenceScorer(autoencoder, length, time_col),
        outputStructType=T.StructType([*features.schema.fields, T.StructField("error", T.DoubleType())]),
        outputMode="Append",
        timeMode="None",
        initialState=past,
    )


def score_sequences(
    features: DataFrame, models: Models, graph_scores: DataFrame, *, threshold: float = schemas.DEFAULT_THRESHOLD, history: DataFrame | None = None, entity: str = "node_name"
) -> DataFrame:
    """Feature records to actions with real sequences: errors from state, the forest, and the stored ``graph_id, s_gnn`` of each entity's graph."""
    coder = models.autoencoder
    errors = sequence_errors(features, coder, models.length, history=history, entity=entity)
    scored = models.forest.score(errors.withColumn("s_lstm", fixed_minmax(F.col("error"), coder.low, coder.high)).drop("error"))
    return fused_actions(scored.join(graph_scores.withColumnRenamed("graph_id", entity), entity, "left"), threshold)


def merge_inputs(*streams: DataFrame) -> DataFrame:
    """Several tagged inputs as one stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


class RunCounter(StatefulProcessor):
    """Length of the current run of anomalous records of one entity, as a single integer of state."""

    def __init__(self, time_col: str, run: int):
        self.time_col, self.run = time_col, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.length = handle.getValueState("length", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(self.time_col)
        length = self.length.get()[0] if self.length.exists() else 0
        times, lengths = [], []
        for t, hit in zip(batch[self.time_col], batch["hit"]):
            length = length + 1 if hit else 0
            if length >= self.run:
                times.append(t)
                lengths.append(length)
        self.length.update((length,))
        if times:
            yield pd.DataFrame({"entity": [key[0]] * len(times), self.time_col: times, "run_length": lengths}).astype(
                {self.time_col: "int64", "run_length": "int32"}
            )

    def close(self) -> None:
        pass


def consecutive_runs(scored_windows: DataFrame, *, entity: str = "node_name", time_col: str = "timestamp", threshold: float = schemas.DEFAULT_THRESHOLD, run: int = RUN_LENGTH) -> DataFrame:
    """Emit each window record that is at least the ``run``-th anomalous one in a row of its entity.

    Input is windowed, so an entity adds one record per window length to a batch.
    Records of an entity must reach the stream in window order across batches.
    """
    use_rocksdb(scored_windows.sparkSession)
    hits = scored_windows.select(F.col(entity).alias("entity"), time_col, F.coalesce(known(F.col("score")) >= threshold, F.lit(False)).alias("hit"))
    return hits.groupBy("entity").transformWithStateInPandas(
        RunCounter(time_col, run),
        outputStructType=f"entity string, {time_col} bigint, run_length int",
        outputMode="Append",
        timeMode="None",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory, and the store the stateful operator needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class LateRows(StreamingQueryListener):
    """Rows dropped behind the watermark by each query of a session, over all its batches: ``total[query.id]``.

    Register it with ``spark.streams.addListener`` before the query starts; a query's own progress keeps recent batches only.
    """

    def __init__(self) -> None:
        self.total: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.total.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.total[str(event.progress.id)] = self.total.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def dropped_late(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark over the query's recent batches; ``LateRows`` counts all of them."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
