from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from telewarden.operators import policy

BOUNDS = [0.0, 0.4999, 0.50, 0.7499, 0.75, 0.8499, 0.85, 0.9499, 0.95, 1.0, None]


def column(spark, build, values, schema="score double"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r.o for r in df.select(build().alias("o")).collect()]


def test_levels_and_actions(spark):
    score = lambda: F.col("score")
    assert column(spark, lambda: policy.alert_level(score()), BOUNDS) == [
        "none", "none", "low", "low", "medium", "medium", "high", "high", "critical", "critical", "none",
    ]
    assert column(spark, lambda: policy.recommend_action(score()), BOUNDS) == [
        "ALLOW", "ALLOW", "LOG", "LOG", "MONITOR", "MONITOR", "ISOLATE", "ISOLATE", "QUARANTINE", "QUARANTINE", "ALLOW",
    ]
    assert column(spark, lambda: policy.audit_required(score()), BOUNDS) == [False] * 6 + [True] * 4 + [False]


@pytest.mark.parametrize(
    ("rule", "score", "confidence", "expected"),
    [
        (policy.isolate, 0.85, 0.90, True), (policy.isolate, 0.85, 0.89, False), (policy.isolate, 0.84, 1.0, False), (policy.isolate, None, 1.0, False),
        (policy.quarantine, 0.95, 0.95, True), (policy.quarantine, 0.95, 0.94, False), (policy.quarantine, 0.95, None, False),
    ],
)
def test_containment(spark, rule, score, confidence, expected):
    assert column(spark, lambda: rule(F.col("s"), F.col("c")), [(score, confidence)], "s double, c double") == [expected]


def test_namespaces_and_roles(spark):
    rows = [("default", 0.69), ("default", 0.70), ("kube-system", 0.64), ("kube-system", 0.65), ("monitoring", 0.0), (None, 0.1), ("default", None)]
    assert column(spark, lambda: policy.namespace_allowed(F.col("n"), F.col("s")), rows, "n string, s double") == [True, False, True, False, False, False, False]
    rows = [("admin", "port-forward"), ("admin", "portforward"), ("admin", "get"), ("developer", "describe"), ("developer", "exec"), ("system", "get"), (None, "get"), ("admin", None)]
    allowed = column(spark, lambda: policy.role_action_allowed(F.col("r"), F.col("a")), rows, "r string, a string")
    assert allowed == [True, True, False, True, False, False, False, False]
    assert column(spark, lambda: policy.user_role(F.col("u")), ["admin", "developer", "system:kubelet", None], "u string") == ["admin", "developer", "system", "system"]


def test_business_hours(spark):
    times = [dt.datetime(2024, 1, 5, 8, 59), dt.datetime(2024, 1, 5, 9, 0), dt.datetime(2024, 1, 5, 17, 59), dt.datetime(2024, 1, 5, 18, 0), dt.datetime(2024, 1, 6, 12), dt.datetime(2024, 1, 7, 12), None]
    assert column(spark, lambda: policy.business_hours(F.col("t")), times, "t timestamp_ntz") == [False, True, True, False, False, False, False]


def test_confidence_and_consensus(spark):
    rows = [(0.9, 0.8, 0.95), (0.1, 0.9, 0.5), (None, 0.9, 0.9)]
    schema = "a double, b double, c double"
    cols = lambda: (F.col("a"), F.col("b"), F.col("c"))
    assert column(spark, lambda: policy.model_confidence(*cols()), rows, schema) == [pytest.approx(0.85), pytest.approx(0.2), None]
    assert column(spark, lambda: policy.high_confidence(policy.model_confidence(*cols())), rows, schema) == [True, False, False]
    assert column(spark, lambda: policy.consensus(0.8, *cols()), rows, schema) == [True, False, False]


def test_violations(spark):
    rows = [(True, True, False), (False, False, True), (True, False, False)]
    build = lambda: policy.violations(F.col("n"), F.col("r"), F.col("s"))
    assert column(spark, build, rows, "n boolean, r boolean, s boolean") == [
        [], ["invalid_action_in_namespace", "unauthorized_user_action", "suspicious_activity_pattern"], ["unauthorized_user_action"],
    ]


PATTERN = "..###.####..##.#N###"  # N: unknown score, which breaks a run


@pytest.fixture(scope="module")
def runs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(node, t + dt.timedelta(minutes=i // 2), i, {"#": 0.9, ".": 0.1, "N": None}[c]) for node in "ab" for i, c in enumerate(PATTERN)]
    return spark.createDataFrame(rows, "node string, ts timestamp, id int, score double").repartition(5)


def test_runs(runs):
    found = policy.consecutive_anomalies(runs, F.col("score") >= 0.85, keys=["node"], order=["ts", "id"])
    assert sorted((r.node, r.run_length) for r in found.collect()) == [("a", 3), ("a", 3), ("a", 4), ("b", 3), ("b", 3), ("b", 4)]
    assert policy.consecutive_anomalies(runs, F.col("score") >= 2, keys=["node"], order=["ts", "id"]).count() == 0


def test_third_in_a_row_is_suspicious(runs):
    out = policy.recent_anomalies(runs, F.col("score") >= 0.85, keys=["node"], order=["ts", "id"]).where("node = 'a'").orderBy("id")
    assert [r.id for r in out.collect() if r.suspicious] == [i for i in range(2, len(PATTERN)) if PATTERN[i - 2 : i + 1] == "###"]


def test_compliance_counts(spark):
    df = spark.createDataFrame([(0.6, 1.0), (0.74, 0.1), (0.9, 0.9), (0.96, 0.96), (0.96, 0.92), (None, None)], "score double, confidence double")
    assert tuple(policy.compliance_metrics(df).first()) == (2, 3, 1)
