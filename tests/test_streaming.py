from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden.operators.features import with_features
from telewarden.operators.windows import window_statistics
from telewarden.plans import views
from telewarden.plans.flagship import FEATURE_COLUMNS
from telewarden.session import scratch_path
from telewarden.sources import readers, writers
from telewarden.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TELEMETRY = "event_id long, ts timestamp, node_name string, user_name string, action string, cpu_usage double, memory_usage double, process_count int"


def run(spark, df, label):
    out = scratch_path(spark, label)
    query = writers.stream_to(df, out, scratch_path(spark, f"{label}-progress"))
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), query


def batches(spark, schema, *parts):
    """A stream that gets one file, and so one micro-batch, per part."""
    location = scratch_path(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(location)
    frame = spark.createDataFrame([], schema)
    return readers.open_records(spark, location, frame.schema, streaming=True, options={"maxFilesPerTrigger": "1"})


def event(i, seconds, node="n", cpu=1.0):
    return (i, T0 + dt.timedelta(seconds=seconds), node, "u", "get", cpu, 2.0, 3)


@pytest.mark.parametrize("slide", [None, "10 seconds"])
def test_closed_windows_equal_the_batch(spark, folder, slide):
    telemetry = views.telemetry(spark, folder)
    location = scratch_path(spark, "telemetry")
    telemetry.repartition(3).write.parquet(location)
    stream = readers.open_records(spark, location, telemetry.schema, streaming=True)
    got, _ = run(spark, jobs.feature_windows(stream, slide=slide), "windows")
    last = telemetry.select((F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - 120_000).alias("t")).first().t
    batch = window_statistics(with_features(telemetry), FEATURE_COLUMNS, slide=slide).where(F.col("timestamp") <= last)
    key = lambda df: {(r.node_name, r.timestamp): (r.window_size, [round(v, 6) for v in r.features]) for r in df.collect()}
    assert key(got) == key(batch) and got.count() == batch.count() > 0


def test_edges_and_late_rows(spark):
    stream = batches(
        spark, TELEMETRY,
        [event(1, 0, cpu=2.0), event(2, 59.999, cpu=4.0), event(3, 60)],
        [event(4, 600)],
        [event(7, 700)],
        [event(5, 10), event(6, 1200)],  # rows are late against the watermark of the batch before
    )
    counter = jobs.LateRows()
    spark.streams.addListener(counter)
    got, query = run(spark, jobs.feature_windows(stream), "late")
    rows = {(r.timestamp - 1704067200000) // 1000: (r.window_size, r.features[0]) for r in got.collect()}
    assert rows == {60: (2, 3.0), 120: (1, 1.0), 660: (1, 1.0), 720: (1, 1.0)}
    assert jobs.dropped_late(query) == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(counter)
    assert counter.total[str(query.id)] == 1


def test_runs_continue_across_batches(spark):
    schema = "node_name string, timestamp long, score double"
    mark = lambda pattern, start, node="a": [(node, (start + i) * 60_000, 0.9 if c == "#" else 0.1) for i, c in enumerate(pattern)]
    stream = batches(spark, schema, mark("##.##", 0) + mark("#", 0, "b"), mark("##.#", 5) + mark("##", 1, "b"), mark("##", 9))
    got, _ = run(spark, jobs.consecutive_runs(stream), "runs")
    assert sorted((r.entity, r.timestamp // 60_000, r.run_length) for r in got.collect()) == [
        ("a", 5, 3), ("a", 6, 4), ("a", 10, 3), ("b", 2, 3),
    ]


def test_stream_scores_equal_batch_scores(spark):
    from telewarden.operators.ensemble import detect, fuse_scores
    from telewarden.plans.models import score_vectors, train_all

    vectors = spark.range(400).select(
        F.col("id"), F.concat(F.lit("n"), F.col("id") % 5).alias("node_name"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("features")
    )
    models = train_all(vectors, id_col="id", trees=10, hidden=4, encoding_dim=2)
    location = scratch_path(spark, "vectors")
    vectors.repartition(3).write.parquet(location)
    stream = readers.open_records(spark, location, vectors.schema, streaming=True, options={"maxFilesPerTrigger": "1"})
    got, _ = run(spark, jobs.score_features(stream, models), "scores")
    expected = {r.id: r.score for r in detect(fuse_scores(score_vectors(vectors, models))).collect()}
    found = {r.id: r.score for r in got.collect()}
    assert found == pytest.approx(expected) and len(found) == 400
    assert {r.action for r in got.collect()} <= {"ALLOW", "LOG", "MONITOR", "ISOLATE", "QUARANTINE"}


def test_merged_inputs_fill_missing_columns(spark):
    a = batches(spark, "tag string, x int", [("a", 1)])
    b = batches(spark, "tag string, y int", [("b", 2)])
    got, _ = run(spark, jobs.merge_inputs(a, b), "merged")
    assert sorted(map(tuple, got.collect())) == [("a", 1, None), ("b", None, 2)]


def test_stream_enrichment(spark):
    from telewarden.operators.telemetry import enrich_metadata

    pods = spark.createDataFrame([("n", "pod-1")], "node_name string, pod string")
    stream = batches(spark, TELEMETRY, [event(1, 0), event(2, 1, node="other")])
    got, _ = run(spark, enrich_metadata(stream, pods), "enriched")
    assert {r.event_id: r.pod for r in got.collect()} == {1: "pod-1", 2: None}


def test_tagged_log_files_as_a_stream(spark):
    from telewarden.operators.telemetry import merge_log

    location = scratch_path(spark, "logs")
    lines = [("container.a", '{"log": "x", "stream": "stdout"}'), ("kubelet", '{"log": "y"}'), ("kubelet", "z" * 99)]
    spark.createDataFrame(lines, "tag string, value string").write.partitionBy("tag").text(location)
    logs = readers.read_logs(spark, location, streaming=True, max_line=80)
    got, _ = run(spark, merge_log(logs.withColumnRenamed("log", "line"), "log string, stream string", field="line"), "logs")
    assert sorted(map(tuple, got.collect()), key=str) == [("container.a", "x", "stdout"), ("kubelet", "y", None)]


def _pattern_models(spark, length):
    from telewarden.operators.autoencoder import SequenceAutoencoder
    from telewarden.operators.pca import PcaModel

    axes, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(length * 2, 3)))
    return SequenceAutoencoder(PcaModel(np.linspace(0, 1, length * 2), axes.T, np.zeros(3)), 0.0, 1.0)


@pytest.mark.parametrize("with_history", [False, True])
def test_sequences_kept_as_state_equal_the_batch(spark, with_history):
    from telewarden.operators.sequence_moments import stretches

    length = 4
    coder = _pattern_models(spark, length)
    rng = np.random.default_rng(1)
    rows = [(f"n{k % 3}", k, None if k == 20 else [float(rng.normal()), float("nan") if k == 31 else 0.5]) for k in range(60)]
    schema = "node_name string, timestamp long, features array<double>"
    cut = 15 if with_history else 0
    stream = batches(spark, schema, rows[cut:25][::-1], [rows[25], rows[24]], rows[26:41], rows[41:])  # one record comes twice
    history = spark.createDataFrame(rows[:cut], schema) if with_history else None
    got, _ = run(spark, jobs.sequence_errors(stream, coder, length, history=history), "sequence-errors")
    found = {}
    for r in got.collect():
        if r.timestamp != 24 or r.error is not None:
            found[r.timestamp] = r.error
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("timestamp"))
    stored = stretches(table, F.col("features"), keys=["node_name"], order=["ts"], length=length, keep=["timestamp"])
    expected = {r.timestamp: r.error for r in coder.row_errors(stored, length).collect() if r.timestamp >= cut}
    assert {t: e for t, e in found.items() if e is not None} == pytest.approx({t: e for t, e in expected.items() if e is not None})
    assert sum(e is not None for e in found.values()) > 25 and got.count() == 61 - cut


def test_restarted_delivery_has_each_row_once(spark, monkeypatch):
    from pyspark.sql import types as T

    from telewarden.streaming import delivery

    schema = "k int, ts timestamp"
    stream = lambda: readers.open_records(spark, location, T.StructType.fromDDL(schema), streaming=True, options={"maxFilesPerTrigger": "1"})
    location, out, progress = (scratch_path(spark, n) for n in ("parts", "delivered", "progress"))
    for part in range(4):
        spark.createDataFrame([(part * 10 + i, T0) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(location)
    calls = []

    def fail_once(batch, before):
        calls.append(before.count())
        if len(calls) == 3:
            batch.write.parquet(f"{out}/batches/query_name=q/batch_id=2")  # written, but never committed
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception):
        delivery.deliver(stream(), out, progress, name="q", prepare=fail_once).awaitTermination()
    read = lambda: sorted(r.k for r in delivery.read_delivered(spark, out, T.StructType.fromDDL(schema)).collect())
    assert len(read()) == 10
    delivery.deliver(stream(), out, progress, name="q", time_col="ts", prepare=fail_once).awaitTermination()
    assert read() == [p * 10 + i for p in range(4) for i in range(5)] and calls == [0, 1, 2, 2, 3]
    # A batch that was committed before its progress was noted is skipped when Spark repeats it.
    delivery.deliver(stream(), out, scratch_path(spark, "fresh-progress"), name="q").awaitTermination()
    assert len(read()) == 20


def test_each_record_has_one_route(spark):
    from pyspark.sql import types as T

    from telewarden.operators.telemetry import parse_telemetry
    from telewarden.streaming import delivery

    def record(k, seconds):
        return '{"event_id": "%s", "timestamp": "%d"}' % (k, 1_704_067_200_000 + seconds * 1000)

    location, out = scratch_path(spark, "lines"), scratch_path(spark, "routes")
    parts = [[record(1, 0), record(2, 600), "{broken"], [record(3, 479), record(4, 480), record(5, -9000), ""], [record(6, 5000)]]
    for part in parts:
        spark.createDataFrame([(p,) for p in part], "value string").coalesce(1).write.mode("append").text(location)
    parsed = parse_telemetry(readers.open_values(spark, location, streaming=True, options={"maxFilesPerTrigger": "1"}))
    delivery.route_records(parsed, out, scratch_path(spark, "routes-progress")).awaitTermination()
    found = delivery.read_delivered(spark, out, T.StructType([*parsed.schema.fields, T.StructField("route", T.StringType())])).collect()
    routes = {}
    for r in found:
        routes.setdefault(r.route, []).append(r._corrupt if r.route == "corrupt" else r.event_id)
    assert {k: sorted(v) for k, v in routes.items()} == {"good": ["1", "2", "4", "6"], "late": ["3", "5"], "corrupt": ["", "{broken"]}
