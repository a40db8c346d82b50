from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.operators import features, signatures, telemetry, windows
from telewarden.session import scratch_path
from telewarden.sources import readers, writers

UTC = dt.timezone.utc


def parse(spark, *records):
    values = [(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records]
    df = spark.createDataFrame(values, "value string")
    return telemetry.parse_telemetry(df, ingest_time=F.lit("2030-01-01 00:00:00").cast("timestamp"))


def test_defaults_shapes_and_times(spark):
    rows = parse(
        spark,
        {},
        {"timestamp": 1704067200123, "node_name": "n", "user_name": "u", "action": "get", "cpu_usage": 1.5, "memory_usage": 2, "process_count": 3},
        {"audit_log": {"timestamp": "2024-01-01T00:00:00Z", "user_name": "u"}, "system_metrics": {"timestamp": "2024-01-01T02:00:00+02:00", "node_name": "n", "cpu_usage": 7}},
        {"timestamp": "not a time", "cpu_usage": "4.5", "process_count": 2.0},
    ).select("*", F.unix_millis("ts").alias("ms")).collect()
    assert (rows[0].node_name, rows[0].user_name, rows[0].action, rows[0].cpu_usage, rows[0].process_count) == ("unknown", "unknown", "unknown", 0.0, 0)
    assert rows[0].ts.year == 2030
    assert (rows[1].ms, rows[1].cpu_usage, rows[1].memory_usage, rows[1].process_count) == (1704067200123, 1.5, 2.0, 3)
    assert (rows[2].ms, rows[2].user_name, rows[2].node_name, rows[2].cpu_usage) == (1704067200000, "u", "n", 7.0)
    assert (rows[3].ts.year, rows[3].cpu_usage, rows[3].process_count) == (2030, 4.5, 2)


def test_bad_records_are_kept_aside(spark):
    good, bad = telemetry.split_corrupt(parse(spark, {"node_name": "n"}, "{broken", None))
    assert [r.node_name for r in good.collect()] == ["n"]
    assert sorted(r.value for r in bad.collect()) == ["", "{broken"]


def test_tag_globs(spark):
    df = spark.createDataFrame([("container.a",), ("containerXa",), ("kube.audit",), ("kubeXaudit",)], "tag string")
    match = lambda glob: [r.tag for r in df.where(telemetry.tag_matches(F.col("tag"), glob)).collect()]
    assert match("container.*") == ["container.a"]
    assert match("kube.audit") == ["kube.audit"]
    assert len(match("*")) == 4


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "t")], "x int, kind string")
    assert sorted(map(tuple, telemetry.union_logs(a, b).collect()), key=str) == [(1, None), (2, "t")]


def test_audit_encoding_defaults_and_unknowns(spark):
    schema = "action string, resource string, status_code int, response_time_ms int, object_count int, is_anomaly boolean, failed_attempts int, bulk_delete boolean"
    rows = [("describe", "secret", None, None, None, True, None, None), ("logs", "secrets", 404, 250, 50, False, 15, True), (None, None, 200, 0, 1, None, 0, False)]
    out = features.audit_features(spark.createDataFrame(rows, schema)).select(*[f"a{i}" for i in range(8)])
    assert [tuple(r) for r in out.collect()] == [
        (0.0, 0.0, 2.0, 0.0, 0.01, 0.0, 0.0, 0.0),
        (9.0, 4.0, 4.04, 0.25, 0.5, 0.0, 1.5, 1.0),
        (0.0, 0.0, 2.0, 0.0, 0.01, 0.0, 0.0, 0.0),
    ]
    labeled = features.audit_features(spark.createDataFrame(rows, schema), include_label=True)
    assert [r.a5 for r in labeled.collect()] == [1.0, 0.0, 0.0]


def test_vector_width_and_zero_divisor(spark):
    df = spark.createDataFrame([("get", "u", 3.0, 4.0, -1)], "action string, user_name string, cpu_usage double, memory_usage double, process_count int")
    v = features.feature_vector(df, pad_to=schemas.VECTOR_WIDTH).first().features
    assert len(v) == 73 and v[:4] == [3.0, 4.0, -1.0, 12.0] and v[4] is None and v[8:] == [0.0] * 65


def test_window_slot_rule(spark):
    names = [f"c{i}" for i in range(73)]
    assert windows.output_slots(["a", "b"]) == [("mean", "a"), ("mean", "b"), ("var", "a"), ("var", "b")]
    slots = windows.output_slots(names, 73)
    assert slots[:37] == [("mean", f"c{i}") for i in range(37)]
    assert slots[37:] == [("var", f"c{i}") for i in range(36)]
    ts = dt.datetime(2024, 1, 1, 0, 1, 0, tzinfo=UTC)
    rows = [("n", ts, 1.0, 5.0), ("n", ts + dt.timedelta(seconds=59), 3.0, 7.0), ("n", ts + dt.timedelta(seconds=60), 9.0, 9.0)]
    df = spark.createDataFrame(rows, "node_name string, ts timestamp, c0 double, c1 double")
    out = windows.window_statistics(df, ["c0", "c1"], width=73).orderBy("timestamp").collect()
    assert [(r.timestamp, r.window_size) for r in out] == [(1704067320000, 2), (1704067380000, 1)]
    assert out[0].features[:2] == [2.0, 6.0] and out[0].features[37:39] == [1.0, 1.0] and len(out[0].features) == 73


@pytest.mark.parametrize("slots", [1, 2, 1440])
def test_gap_fill(spark, monkeypatch, slots):
    monkeypatch.setattr(windows, "CALENDAR_SLOTS", slots)
    stats = spark.createDataFrame([(0, "a", 2, [1.0, 2.0]), (180_000, "a", 1, [3.0, 4.0]), (60_000, "b", 1, [5.0, 6.0])], schemas.FEATURE_WINDOW)
    rows = windows.fill_gaps(stats, length_ms=60_000, width=2).orderBy("node_name", "timestamp").collect()
    assert [(r.node_name, r.timestamp, r.window_size) for r in rows] == [("a", 0, 2), ("a", 60_000, 0), ("a", 120_000, 0), ("a", 180_000, 1), ("b", 60_000, 1)]
    assert rows[1].features == [0.0, 0.0]


def test_signatures(spark):
    base = dict(action="get", resource="pods", namespace="default", status_code=200, response_time_ms=1, object_count=1, bulk_delete=None, unusual_time=None, frequency_anomaly=None)
    cases = {
        "brute_force_auth": dict(status_code=401, resource="secret"),
        "privilege_escalation": dict(action="update", resource="rbac"),
        "data_exfiltration": dict(response_time_ms=5000, object_count=1000),
        "malicious_deletion": dict(action="delete", bulk_delete=True),
        "unauthorized_access": dict(status_code=403, resource="rbac", namespace="kube-system"),
        "unusual_patterns": dict(unusual_time=True),
        "none": {},
    }
    schema = "action string, resource string, namespace string, status_code int, response_time_ms int, object_count int, bulk_delete boolean, unusual_time boolean, frequency_anomaly boolean"
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c in cases.values()], schema)
    assert [r.signature for r in signatures.tag_signatures(df).collect()] == list(cases)
    assert signatures.tag_signatures(df.drop("unusual_time", "bulk_delete")).columns == [c for c in df.columns if c not in ("unusual_time", "bulk_delete")] + ["signature"]


def test_row_ids_follow_file_order(spark):
    location = scratch_path(spark, "rows")
    spark.range(1000).select(F.col("id").cast("string").alias("value")).coalesce(1).write.text(location)
    out = readers.with_row_id(spark.read.text(location)).collect()
    assert all(r.row_id == int(r.value) for r in out) and len(out) == 1000


def test_log_reader_drops_long_lines(spark):
    location = scratch_path(spark, "lines")
    spark.createDataFrame([("short",), ("x" * 50,)], "value string").write.text(location)
    assert [r.log for r in readers.read_logs(spark, location, tag="t", max_line=10).collect()] == ["short"]


def test_csv_inference_and_matrix(spark):
    location = writers.write_csv_table(spark.createDataFrame([(1, 2.5)], "a int, b double"), scratch_path(spark, "csv"))
    assert readers.read_csv_table(spark, location).dtypes == [("a", "int"), ("b", "double")]
    m = writers.write_feature_csv(spark.createDataFrame([(1.0, 2.5)], "a double, b double"), scratch_path(spark, "m"), ["a", "b"])
    assert readers.read_csv_matrix(spark, m, 2).first().features == [1.0, 2.5]


def test_missing_model_is_an_error(spark):
    from telewarden.plans.models import load_models

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_models(spark, scratch_path(spark, "nothing"))
