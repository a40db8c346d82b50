"""Record schemas, fixed value lists and the feature declaration."""

from __future__ import annotations

from pyspark.sql import types as T

# Audit actions in encoding order; anything else encodes as 0.
AUDIT_ACTIONS = ["get", "list", "create", "update", "patch", "delete", "watch", "exec", "port-forward", "logs"]
# Audit resources in encoding order; anything else encodes as 0.
AUDIT_RESOURCES = ["pods", "deployments", "services", "configmaps", "secrets"]

# Ensemble weights, severity bounds and window length.
ENSEMBLE_WEIGHTS = {"lstm": 0.47, "isolation_forest": 0.28, "gnn": 0.25}
SEVERITY_LOW, SEVERITY_MEDIUM, SEVERITY_HIGH, SEVERITY_CRITICAL = 0.50, 0.75, 0.85, 0.95
DEFAULT_THRESHOLD = 0.85
WINDOW_LENGTH = "60 seconds"
SEQUENCE_LENGTH = 60
VECTOR_WIDTH = 73
ACTION_CODES, USER_CODES = 20, 50

AUDIT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
    ]
)

AUDIT_LOG_EXTENDED = T.StructType(
    AUDIT_LOG.fields
    + [
        T.StructField("response_time_ms", T.IntegerType()),
        T.StructField("object_count", T.IntegerType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("failed_attempts", T.IntegerType()),
        T.StructField("unusual_privilege_change", T.BooleanType()),
        T.StructField("bulk_delete", T.BooleanType()),
        T.StructField("unusual_time", T.BooleanType()),
        T.StructField("frequency_anomaly", T.BooleanType()),
    ]
)

SYSTEM_METRICS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("node_name", T.StringType()),
        T.StructField("cpu_usage", T.DoubleType()),
        T.StructField("memory_usage", T.DoubleType()),
        T.StructField("network_in", T.LongType()),
        T.StructField("network_out", T.LongType()),
        T.StructField("process_count", T.IntegerType()),
        T.StructField("disk_usage", T.DoubleType()),
    ]
)

TELEMETRY = T.StructType([T.StructField("audit_log", AUDIT_LOG), T.StructField("system_metrics", SYSTEM_METRICS)])


def _as_text(schema: T.StructType, *names: str) -> T.StructType:
    """The named fields as strings, for JSON whose times and numbers come in several forms."""
    return T.StructType([T.StructField(n, T.StringType()) for n in (names or schema.fieldNames())])


# One schema for both accepted shapes, flat keys and the nested pair.
TELEMETRY_TEXT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in [
            "event_id", "timestamp", "node_name", "user_name", "action",
            "cpu_usage", "memory_usage", "process_count",
        ]
    ]
    + [
        T.StructField("audit_log", _as_text(AUDIT_LOG)),
        T.StructField("system_metrics", _as_text(SYSTEM_METRICS)),
        T.StructField("_corrupt", T.StringType()),
    ]
)

FEATURE_WINDOW = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("node_name", T.StringType()),
        T.StructField("window_size", T.LongType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)

FOREST_NODE = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
