"""Telemetry, audit, score, graph and log views over the ``events`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.operators.graph import build_edges, transition_events
from telewarden.session import prepare
from telewarden.sources.readers import read_table


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(prepare(spark), folder, "events")


def _node() -> Column:
    return F.concat(F.lit("node-"), (F.col("user_id") % 8).cast("string"))


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("double")


def _pick(number: Column, values: Sequence, otherwise) -> Column:
    return F.coalesce(*[F.when(number == i, F.lit(v)) for i, v in enumerate(values)], F.lit(otherwise))


def _metric_columns() -> list[Column]:
    return [F.col("value").alias("cpu_usage"), _k().alias("memory_usage"), (F.col("event_id") % 200).cast("int").alias("process_count")]


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id",
        "ts",
        _node().alias("node_name"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_name"),
        F.col("event_type").alias("action"),
        *_metric_columns(),
    )


def telemetry_with_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and the audit log of each event, in one projection."""
    return events(spark, folder).select("event_id", "ts", _node().alias("node_name"), *_metric_columns(), *_audit_columns())


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id",
        "ts",
        _node().alias("node_name"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x1"),
        F.when(F.col("event_id") % 11 >= 2, _k()).alias("x2"),
        (F.col("event_id") % 200).cast("double").alias("x3"),
        F.lit(5.0).alias("x4"),
    )


DIRTY_COLUMNS = ["x1", "x2", "x3", "x4"]


def _audit_columns() -> list[Column]:
    e, u = F.col("event_id"), F.col("user_id")
    users = ["admin", "developer", "system:apiserver", "system:kubelet", "suspicious_user"]
    actions = ["get", "list", "create", "update", "patch", "delete", "watch", "exec", "port-forward", "logs"]
    resources = ["pods", "deployments", "services", "configmaps", "secrets", "rbac"]
    return [
        _pick(u % 6, users, "unknown_user").alias("user_name"),
        _pick(e % 11, actions, "describe").alias("action"),
        _pick(u % 7, resources, "secret").alias("resource"),
        _pick(u % 3, ["default", "kube-system"], "monitoring").alias("namespace"),
        _pick(e % 5, [200, 201, 401, 403], None).alias("status_code"),
        F.when(e % 10 != 0, F.floor(F.col("value") * 100).cast("int")).alias("response_time_ms"),
        F.when(e % 13 != 0, (e % 3000).cast("int")).alias("object_count"),
        F.when(F.col("event_type") == "error", (u % 21).cast("int")).alias("failed_attempts"),
        (F.col("event_type") == "signup").alias("bulk_delete"),
        (F.col("event_type") == "error").alias("is_anomaly"),
    ]


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", "ts", *_audit_columns())


def _score_columns() -> list[Column]:
    return [
        F.least(F.col("value") / 100, F.lit(1.0)).alias("s_lstm"),
        (_k() / 100).alias("s_if"),
        ((F.col("event_id") % 101).cast("double") / 100).alias("s_gnn"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
    ]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", "ts", _node().alias("node_name"), *_score_columns())


def policy_input(spark: SparkSession, folder: str) -> DataFrame:
    """Scored audit logs with fused score, confidence and role, in one projection of the events."""
    from telewarden.operators.ensemble import fuse_scores
    from telewarden.operators.policy import model_confidence, user_role

    both = events(spark, folder).select("event_id", "ts", _node().alias("node_name"), *_audit_columns(), *_score_columns())
    confidence = model_confidence(F.col("s_lstm"), F.col("s_if"), F.col("s_gnn"))
    return fuse_scores(both).withColumns({"confidence": confidence, "user_role": user_role(F.col("user_name"))})


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        events(spark, folder)
        .groupBy("user_id")
        .agg(F.avg("value").alias("f0"), F.avg(_k()).alias("f1"), F.avg((F.col("event_id") % 200).cast("double")).alias("f2"))
        .select(_node().alias("graph_id"), F.col("user_id").alias("node_id"), "f0", "f1", "f2")
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    visits = events(spark, folder).select("event_id", "ts", _node().alias("graph_id"), "user_id", F.col("value").alias("traffic"))
    return build_edges(transition_events(visits, graph="graph_id", node="user_id", order=["ts", "event_id"]))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    tag = F.when(e % 3 == 0, F.lit("kube.audit")).when(e % 3 == 1, F.lit("kubelet")).otherwise(F.concat(F.lit("container."), F.col("event_type")))
    return events(spark, folder).select("event_id", "ts", tag.alias("tag"), F.col("props").alias("log"))


def pods(spark: SparkSession, folder: str) -> DataFrame:
    """Pod dimension from the regions; node-7 has no entry."""
    region = read_table(prepare(spark), folder, "region")
    numbered = region.select("r_name", F.explode(F.array(F.col("r_regionkey"), F.col("r_regionkey") + 5)).alias("i"))
    return numbered.where("i < 7").select(F.concat(F.lit("node-"), F.col("i").cast("string")).alias("node_name"), "r_name")


def gappy_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """The telemetry view with NaN for some CPU values and null for some memory values."""
    e = F.col("event_id")
    return telemetry(spark, folder).withColumns({
        "cpu_usage": F.when(e % 9 == 4, F.lit(float("nan"))).otherwise(F.col("cpu_usage")),
        "memory_usage": F.when(e % 7 != 3, F.col("memory_usage")),
    })


def gappy_scored(spark: SparkSession, folder: str) -> DataFrame:
    """The score view with NaN for some sequence scores and null for some forest scores."""
    e = F.col("event_id")
    return scored(spark, folder).withColumns({
        "s_lstm": F.when(e % 9 == 4, F.lit(float("nan"))).otherwise(F.col("s_lstm")),
        "s_if": F.when(e % 7 != 3, F.col("s_if")),
    })
